"""Mining of source files: their elements, marked comments, documentation and architectural patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import arrow
from quillstone.functions import rules as R
from quillstone.functions import scalars as S
from quillstone.tables import durable

MIN_DOCSTRING, MIN_CONFIDENCE, MIN_COMMENTS, SHOWN_COMMENTS, SHOWN_MATCHES, MOST_TAGS = 50, 30, 3, 20, 5, 5

# What begins an element, by language; each is tried at a line's start, the first that fits counts.
# Groups: name, and arguments where there are some.
_SCRIPT = [
    ("class", r"(?:export\s+)?(?:default\s+)?class\s+(\w+)(?:\s+extends\s+\w+)?\s*\{"),
    ("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)"),
    ("function", r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*=>"),
    ("function", r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?function\s*\(([^)]*)\)"),
]
ELEMENTS = {
    "python": [("class", r"class\s+(\w+)(?:\s*\([^)]*\))?\s*:"), ("function", r"\s*def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*[^:]+)?\s*:")],
    "javascript": _SCRIPT, "typescript": _SCRIPT,
    "go": [
        ("class", r"type\s+(\w+)\s+struct\s*\{"), ("class", r"type\s+(\w+)\s+interface\s*\{"), ("method", r"func\s+\([^)]+\)\s+(\w+)\s*\(([^)]*)\)"),
        ("function", r"func\s+(\w+)\s*\(([^)]*)\)"),
    ],
    "ruby": [("class", r"\s*class\s+(\w+)(?:\s*<\s*\w+)?"), ("class", r"\s*module\s+(\w+)"), ("function", r"\s*def\s+(\w+[!?=]?)(?:\s*\(([^)]*)\))?")],
    "": [
        ("function", r"\s*(?:public|private|protected)?\s*func\s+(\w+)\s*\("), ("function", r"\s*def\s+(\w+)\s*\("), ("function", r"\s*function\s+(\w+)\s*\("),
        ("function", r"\s*(?:void|int|string|bool|float)\s+(\w+)\s*\("),
    ],
}
# What a file imports, by language.
IMPORTS = {
    "python": [r"(?m)^import\s+(\S+)", r"(?m)^from\s+(\S+)\s+import"],
    "javascript": [r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"],
    "typescript": [r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"],
    "go": [r'import\s+"([^"]+)"'], "ruby": [r"require\s+['\"]([^'\"]+)['\"]", r"require_relative\s+['\"]([^'\"]+)['\"]"],
}
_DECORATOR = re.compile(r"\s*@(\w+(?:\.\w+)*)")
_COMPILED = {language: [(kind, re.compile(p)) for kind, p in patterns] for language, patterns in ELEMENTS.items()}

ELEMENT = "struct<element_type:string,name:string,docstring:string,signature:string,start_line:int,end_line:int,decorators:array<string>,parent:string>"
#: Marked comments as "[MARK] text", in SQL's dialect and Java's.
MARKED = r"(?://|#|/\*)\s*(" + "|".join(R.MARKERS) + r")\s*:?\s*([^\n]+?)(?:\*/)?$"


def _doc_after(lines: list[str], at: int) -> str | None:
    """A string of three quotes on the next line that isn't blank."""
    while at < len(lines) and not lines[at].strip():
        at += 1
    text = lines[at].strip() if at < len(lines) else ""
    mark = text[:3]
    if mark not in ('"""', "'''"):
        return None
    rest = [text[3:], *lines[at + 1 :]]
    said = []
    for line in rest:
        before, found, _ = line.partition(mark)
        said.append(before.strip())
        if found:
            return "\n".join(said).strip() or None
    return None


def _doc_before(lines: list[str], at: int, mark: str) -> str | None:
    """A block comment that ends on the line before, or the run of comment lines above."""
    i = at - 1
    if i < 0:
        return None
    if mark == "//" and lines[i].strip().endswith("*/"):
        said = []
        while i >= 0:
            line = lines[i].strip()
            said.append(re.sub(r"^/?\*+\s?|\s*\*+/$", "", line).strip())
            if line.startswith("/*"):
                return "\n".join(reversed(said)).strip() or None
            i -= 1
        return None
    said = []
    while i >= 0 and lines[i].strip().startswith(mark):
        said.append(lines[i].strip()[len(mark) :].strip())
        i -= 1
    return "\n".join(reversed(said)).strip() or None


def parse_source(language: str, text: str) -> list[dict]:
    """Elements of a source text, by the patterns of its language. Methods name the class that is open where they stand."""
    lines, patterns, found = text.split("\n"), _COMPILED.get(language, _COMPILED[""]), []
    decorators: list[str] = []
    inside, depth = None, 0
    python = language == "python"
    for i, line in enumerate(lines):
        if python and "@" in line and (m := _DECORATOR.match(line)):
            decorators.append(m[1])
            continue
        subject = line.strip() if language in ("javascript", "typescript") else line
        # Of Python's lines only those with such a word can begin an element.
        for kind, pattern in patterns if not python or "def" in line or "class" in line else ():
            m = pattern.match(subject)
            if not m:
                continue
            name, arguments = m[1], (m[2] or "") if pattern.groups > 1 else ""
            indent = len(line) - len(line.lstrip())
            parent = None
            if kind == "class":
                inside, depth = name, indent
            elif language in ("python", "ruby") and inside and indent > depth:
                kind, parent = "method", inside
            elif language == "go" and kind == "method":
                receiver = re.match(r"func\s+\([^)]*?\*?(\w+)\)", line)
                parent = receiver[1] if receiver else None
            doc = _doc_after(lines, i + 1) if language == "python" else _doc_before(lines, i, "#" if language == "ruby" else "//")
            signature = subject.strip() if kind == "class" else f"{'def ' if language in ('python', 'ruby') else 'func ' if language == 'go' else ''}{name}({arguments})"
            found.append({"element_type": kind, "name": name, "docstring": doc, "signature": signature, "start_line": i + 1, "end_line": None, "decorators": decorators, "parent": parent})
            decorators = []
            break
        if language == "python" and line and not line[0].isspace() and not line.startswith(("def", "class", "@")):
            inside = None
    return found


def imports_of(language: str, text: str) -> list[str]:
    found = [x for p in IMPORTS.get(language, []) for x in re.findall(p, text)]
    if language == "python":  # of a list of modules the first
        found = [x.split(",")[0].strip() for x in found]
    if language == "go":
        found += [x for group in re.findall(r"(?s)import\s*\((.*?)\)", text) for x in re.findall(r'"([^"]+)"', group)]
    return list(dict.fromkeys(found))


def marked_comments(content: Column) -> Column:
    """Array of "[MARK] text"."""
    pattern = F.lit("(?im)" + MARKED)
    marks, texts = F.regexp_extract_all(content, pattern, 1), F.regexp_extract_all(content, pattern, 2)
    return F.filter(F.zip_with(marks, texts, lambda m, t: F.concat(F.lit("["), F.upper(m), F.lit("] "), F.trim(t))), lambda c: ~c.rlike(r"\] $"))


def parse(files: DataFrame) -> DataFrame:
    """files (path, content) of known languages with language, line_count, content_hash, comments, elements and imports.
    Only elements and imports need Python; the rest are columns."""
    known = files.withColumn("language", S.language_of_path(F.col("path"))).where("language is not null and content is not null")
    known = known.withColumns({"line_count": F.regexp_count("content", F.lit("\n")) + 1, "content_hash": S.file_hash(F.col("content")), "comments": marked_comments(F.col("content"))})
    element = pa.struct([(n, t) for n, t in (
        ("element_type", pa.string()), ("name", pa.string()), ("docstring", pa.string()), ("signature", pa.string()), ("start_line", pa.int32()),
        ("end_line", pa.int32()), ("decorators", pa.list_(pa.string())), ("parent", pa.string()),
    )])
    names = known.columns

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(names.index("language")).to_pylist(), batch.column(names.index("content")).to_pylist(), strict=True))
            columns = [arrow.lists([parse_source(*p) for p in pairs], element), arrow.lists([imports_of(*p) for p in pairs], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, "elements", "imports"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
    return known.mapInArrow(run, f"{schema}, elements array<{ELEMENT}>, imports array<string>")


def docstring_confidence(doc: Column, kind: Column) -> Column:
    """In hundredths."""
    add = lambda c, n: F.when(c, n).otherwise(0)
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(doc, w))
    score = F.lit(30) + add(F.length(doc) > 100, 15) + add(some(R.EXAMPLES), 10) + add(some(R.PARAMETERS), 10) + add(some(R.RETURNS), 10) - add(F.length(doc) < 100, 10) + add(kind == "class", 10)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def _sorted_tags(*columns: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(F.array(*columns)))), 1, MOST_TAGS)


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def docstrings(parsed: DataFrame, project: str | None = None) -> DataFrame:
    """An entry for each element with documentation of some length."""
    e = parsed.select("path", "language", F.explode("elements").alias("e")).where(F.length("e.docstring") >= MIN_DOCSTRING)
    e = e.withColumn("hundredths", docstring_confidence(F.col("e.docstring"), F.col("e.element_type"))).where(F.col("hundredths") >= MIN_CONFIDENCE)
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in R.ELEMENT_PREFIXES.items() for x in pair]), F.col("e.element_type")), F.lit(""))
    # The first paragraph on one line.
    first = F.regexp_replace(S.stripped(F.split("e.docstring", "\n\n")[0]), r"(?U)\s+", " ")
    decorators = F.array_join(F.transform("e.decorators", lambda d: F.concat(F.lit("`@"), d, F.lit("`"))), ", ")
    content = F.array_join(F.array_compact(F.array(
        F.when(F.coalesce("e.signature", F.lit("")) != "", F.concat(F.lit("```"), "language", F.lit("\n"), "e.signature", F.lit("\n```"))),
        F.concat(F.lit("\n## Documentation\n\n"), "e.docstring"), F.concat(F.lit("\n**File:** `"), _base(F.col("path")), F.lit("` (line "), F.col("e.start_line").cast("string"), F.lit(")")),
        F.when(F.size("e.decorators") > 0, F.concat(F.lit("\n**Decorators:** "), decorators)),
    )), "\n")
    return e.select(
        F.trim(F.concat(prefix, F.lit(" "), F.when(F.col("e.parent").isNotNull(), F.concat("e.parent", F.lit("."))).otherwise(""), "e.name")).alias("title"),
        F.when(F.length(first) > 200, F.concat(F.substring(first, 1, 197), F.lit("..."))).otherwise(first).alias("description"),
        content.alias("content"),
        _sorted_tags(F.lower(F.lit(project)), F.col("language"), F.col("e.element_type")).alias("tags"), (F.col("hundredths") / 100).alias("confidence"),
        F.lit("docstring").alias("extraction_type"), F.array("path").alias("source_refs"),
    )


def pattern_matches(parsed: DataFrame, rules: dict = R.PATTERNS) -> DataFrame:
    """(pattern_type, path, name, confidence, evidence, start_line, language, signature, docstring): classes with evidence
    for a pattern: name and path count 1, each method word 0.5; from 1.5 on they match. Signature and docstring are of the
    file's first element of that name."""
    classes = parsed.select("path", "language", "elements", F.explode("elements").alias("e")).where("e.element_type = 'class'")
    methods = F.transform(F.filter("elements", lambda x: (x["element_type"] == "method") & (x["parent"] == F.col("e.name"))), lambda x: F.lower(x["name"]))
    named = F.filter("elements", lambda x: x["name"] == F.col("e.name"))[0]
    classes = classes.select("path", "language", F.col("e.name").alias("name"), F.col("e.start_line").alias("start_line"), methods.alias("methods"), named["signature"].alias("signature"), named["docstring"].alias("docstring"))

    def any_of(c: Column, patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | c.rlike("(?i)" + p)
        return out

    def has(word: str):
        return lambda m: F.contains(m, F.lit(word))

    scores = []
    for kind, (names, paths, words) in rules.items():
        # Halves, so that sums are exact. Only lower-case words can be in lower-cased names.
        signs = [(any_of(F.col("name"), names), 2, f"Name matches {kind} pattern"), (any_of(F.col("path"), paths), 2, f"File path matches {kind} pattern")]
        signs += [(F.exists("methods", has(w)), 1, f"Has {w} method") for w in words]
        points = sum((F.when(sign, n).otherwise(0) for sign, n, _ in signs), F.lit(0))
        evidence = F.array_compact(F.array(*[F.when(sign, F.lit(said)) for sign, _, said in signs]))
        scores.append(F.struct(F.lit(kind).alias("pattern_type"), points.alias("halves"), evidence.alias("evidence")))
    found = classes.withColumn("s", F.explode(F.array(*scores))).where("s.halves >= 3")
    return found.select("s.pattern_type", "path", "name", F.least(F.lit(1.0), F.col("s.halves") / 6).alias("confidence"), "s.evidence", "start_line", "language", "signature", "docstring")


def name_suffix(name: Column) -> Column:
    """The last word of a name, lower-cased."""
    camel = F.regexp_extract_all(name, F.lit("([A-Z][a-z]*)"), 1)
    return F.lower(F.when(F.contains(name, F.lit("_")), F.element_at(F.split(name, "_"), -1)).when(F.size(camel) > 0, F.element_at(camel, -1)).otherwise(name))


def pattern_groups(matches: DataFrame) -> DataFrame:
    """(pattern_type, n, avg_confidence, consistent, hundredths) of patterns with two matches or more."""
    g = matches.groupBy("pattern_type").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), (F.count_distinct(name_suffix(F.col("name"))) == 1).alias("consistent"),
    ).where("n >= 2")
    return g.withColumn("hundredths", 30 + F.when(F.col("n") >= 3, 20).otherwise(0) + F.when(F.col("avg_confidence") > 0.5, 10).otherwise(0) + F.when(F.col("consistent"), 10).otherwise(0))


def comment_groups(parsed: DataFrame, project: str | None = None) -> DataFrame:
    """An entry for each mark with several comments, the first of them listed."""
    c = parsed.select("path", F.posexplode("comments").alias("at", "c")).select(
        "path", "at", F.regexp_extract("c", r"^\[(\w+)\]\s*(.+)", 1).alias("mark"), F.regexp_extract("c", r"^\[(\w+)\]\s*(.+)", 2).alias("text")
    ).where("mark <> ''")
    counts = c.groupBy("mark").agg(F.count("*").alias("n"), F.collect_set("path").alias("paths")).where(F.col("n") >= MIN_COMMENTS)
    # Ranked before grouping, so that no group is larger than what is shown.
    from pyspark.sql.window import Window

    ranked = c.withColumn("nth", F.row_number().over(Window.partitionBy("mark").orderBy("path", "at"))).where(F.col("nth") <= SHOWN_COMMENTS)
    line = F.concat(F.lit("- `"), F.element_at(F.split("path", "/"), -1), F.lit("`: "), "text")
    shown = ranked.groupBy("mark").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    rest = F.when(F.col("n") > SHOWN_COMMENTS, F.concat(F.lit("\n\n_... and "), (F.col("n") - SHOWN_COMMENTS).cast("string"), F.lit(" more_"))).otherwise("")
    return counts.join(shown, "mark").select(
        F.concat(F.lit("Code "), "mark", F.lit("s")).alias("title"), F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" "), "mark", F.lit(" comments across the codebase.")).alias("description"),
        F.concat(F.lit("## "), "mark", F.lit(" Comments\n\n"), "lines", rest).alias("content"), F.array_compact(F.array(F.lower("mark"), F.lower(F.lit(project)))).alias("tags"),
        F.when(F.col("mark") == "TODO", 0.35).otherwise(0.45).alias("confidence"), F.lit("comment").alias("extraction_type"), F.array_sort("paths").alias("source_refs"),
    )


def pattern_entries(parsed: DataFrame, project: str | None = None) -> DataFrame:
    """An entry for each pattern with several matches; the first five are shown, in the order of their files."""
    from pyspark.sql.window import Window

    # Sources are parsed once, for the matches and for the languages of all files; of each pattern no more is brought together
    # than the files that it refers to and the matches that are shown.
    parsed = durable(parsed.select("path", "language", "elements"))
    m = durable(pattern_matches(parsed))
    some = ("path", "start_line", "name", "evidence", "language", "signature", "docstring")
    first = m.withColumn("nth", F.row_number().over(Window.partitionBy("pattern_type").orderBy(*some))).where(F.col("nth") <= SHOWN_MATCHES)
    first = first.groupBy("pattern_type").agg(F.sort_array(F.collect_list(F.struct(*some))).alias("found"))
    listed = m.groupBy("pattern_type").agg(F.sort_array(F.collect_list("path")).alias("paths")).join(first, "pattern_type")
    g = pattern_groups(m).where(F.col("hundredths") >= MIN_CONFIDENCE).join(listed, "pattern_type")
    of = lambda values, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("pattern_type")), F.concat(F.initcap("pattern_type"), F.lit(other)))

    def shown(f):
        parts = F.array(F.concat(F.lit("\n### "), f["name"], F.lit("\n")), F.concat(F.lit("**File:** `"), _base(f["path"]), F.lit("`\n")))
        evidence = F.when(F.size(f["evidence"]) > 0, F.concat(F.array(F.lit("**Evidence:**\n")), F.transform(f["evidence"], lambda e: F.concat(F.lit("- "), e)))).otherwise(F.array().cast("array<string>"))
        none = F.array().cast("array<string>")
        signature = F.when(F.coalesce(f["signature"], F.lit("")) != "", F.array(F.concat(F.lit("\n```"), f["language"]), f["signature"], F.lit("```"))).otherwise(none)
        doc = F.when(F.coalesce(f["docstring"], F.lit("")) != "", F.array(F.concat(F.lit("\n_"), S.stripped(F.split(f["docstring"], "\n")[0]), F.lit("_")))).otherwise(none)
        return F.concat(parts, evidence, signature, doc)

    names = F.array_join(F.transform(F.slice("found", 1, 3), lambda f: f["name"]), ", ")
    more = lambda n, text: F.when(F.col("n") > n, F.concat(F.lit(text), (F.col("n") - n).cast("string"), F.lit(" more")))
    lines = F.concat(F.array(F.concat(F.lit("## "), F.initcap("pattern_type"), F.lit(" Pattern Instances\n"))), F.flatten(F.transform(F.slice("found", 1, SHOWN_MATCHES), shown)), F.array_compact(F.array(F.concat(more(SHOWN_MATCHES, "\n_... and "), F.lit(" instances_")))))
    # The languages of all files, few.
    languages = parsed.agg(F.collect_set("language")).scalar()
    tags = F.concat(F.array_compact(F.array(F.lower(F.lit(project)))), languages, F.array(F.replace("pattern_type", F.lit("_"), F.lit("-"))))
    return g.select(
        of(R.PATTERN_TITLES, " Pattern").alias("title"),
        F.concat(of(R.PATTERN_ABOUT, " design pattern"), F.lit(". Found "), F.col("n").cast("string"), F.lit(" instances: "), names, F.coalesce(more(3, ", and "), F.lit("")), F.lit(".")).alias("description"),
        F.array_join(lines, "\n").alias("content"), F.slice(F.sort_array(F.array_distinct(tags)), 1, MOST_TAGS).alias("tags"),
        (F.col("hundredths") / 100).alias("confidence"), F.lit("pattern").alias("extraction_type"), F.col("paths").alias("source_refs"),
    )


def extract(parsed: DataFrame, project: str | None = None) -> DataFrame:
    parsed = durable(parsed.select("path", "language", "comments", "elements"))  # parsed once for all three
    return docstrings(parsed, project).unionByName(pattern_entries(parsed, project)).unionByName(comment_groups(parsed, project))
