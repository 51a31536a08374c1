"""Column builders for entries: text, tags, hashes, vectors and scores. All are built-in expressions."""

from __future__ import annotations

import re
import socket
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Limits of an entry, and the thresholds of its quality.
MAX_TITLE, MAX_DESCRIPTION, MAX_CONTENT = 500, 10_000, 1_000_000
GOOD_DESCRIPTION, GOOD_CONTENT = 50, 100
CHARS_PER_TOKEN = 4

# Languages by file extension; source trees and diffs know one more each.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rb": "ruby",
    ".rs": "rust", ".java": "java", ".kt": "kotlin", ".swift": "swift", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".php": "php", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
}
SOURCE_LANGUAGES = LANGUAGES | {".pyi": "python"}
DIFF_LANGUAGES = LANGUAGES | {".sql": "sql"}


# What counts as white space around a text.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """c without white space of any kind around it."""
    return F.btrim(c, F.lit(WHITE))


def left_stripped(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def let(value: Column, made) -> Column:
    """made(value), where value is worked out once however often it occurs."""
    return F.transform(F.array(value), made)[0]


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone, the rule by which substring search folds case."""
    return F.translate(c, _UPPER, _LOWER)


def has_text(c: Column, text: str) -> Column:
    """Whether c contains text, whose % and _ stand for themselves."""
    return F.contains(ascii_lower(c), F.lit(text.translate(str.maketrans(_UPPER, _LOWER))))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("long")


def brief(c: Column, most: int = 200) -> Column:
    """c if it is short; else cut, at a space where one is in the second half, with dots."""
    cut = F.substring(c, 1, most)
    behind = F.instr(F.reverse(cut), " ")
    at = F.lit(most) - behind
    shorter = F.when((behind > 0) & (at > most // 2), F.substring(c, F.lit(1), at)).otherwise(cut)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(shorter, r"\s+$", ""), F.lit("...")))


def shortened(c: Column, most: int = 80, least: int = 40) -> Column:
    """A title's cut: to most - 3 at a space after least, with dots."""
    cut = F.substring(c, 1, most - 3)
    behind = F.instr(F.reverse(cut), " ")
    at = F.lit(most - 3) - behind
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.when((behind > 0) & (at > least), F.substring(c, F.lit(1), at)).otherwise(cut), F.lit("...")))


def capitalized(c: Column) -> Column:
    """c with its first letter in upper case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def entry_id(title: Column, created: Column) -> Column:
    """The first 12 hex digits of the hash of title and creation time (ISO text)."""
    return F.substring(F.sha2(F.concat(title, created), 256), 1, 12)


def content_hash(title: Column, description: Column, content: Column) -> Column:
    parts = [F.coalesce(x, F.lit("")) for x in (title, description, content)]
    return F.sha2(F.concat(parts[0], F.lit("\n"), parts[1], F.lit("\n"), parts[2]), 256)


def full_hash(*columns: Column) -> Column:
    """A hash of any columns, nulls told from empty ones; sees what content_hash leaves out."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def file_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def parse_tags(c: Column) -> Column:
    """Comma-separated text as lower-cased, trimmed, non-empty tags."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.lower(stripped(t))), lambda t: t != "")


def tags_from_json(c: Column) -> Column:
    """A JSON array of strings; an empty array if it is none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def tags_to_json(c: Column) -> Column:
    return F.to_json(c)


def has_tags(tags: Column, wanted: list[str]) -> Column:
    """All wanted tags are there, as they are written."""
    out = F.lit(True)
    for t in wanted:
        out = out & F.array_contains(tags, t)
    return out


def has_tags_like(tags: Column, wanted: list[str], most: int = 2) -> Column:
    """For each wanted tag some tag is within most edits of it."""
    def near(wanted_tag: str):
        return lambda x: F.levenshtein(F.lower(x), F.lit(wanted_tag.lower()), most) >= 0

    out = F.lit(True)
    for t in wanted:
        out = out & F.exists(tags, near(t))
    return out


def sanitized(c: Column) -> Column:
    """Text for embedding: white space runs and unusual signs become spaces."""
    spaced = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)[^\w\s.,!?;:\-()]", " "))


def embedding_text(title: Column, description: Column, content: Column) -> Column:
    return F.concat(title, F.lit(". "), description, F.lit(". "), content)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the cosine of unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def quality(tags: Column, description: Column, content: Column, usage: Column) -> Column:
    """25 points each for tags, a description, content and use."""
    points = lambda c: F.when(c, 25).otherwise(0)
    return (
        points(F.coalesce(F.size(tags), F.lit(0)) > 0) + points(F.length(F.coalesce(description, F.lit(""))) >= GOOD_DESCRIPTION)
        + points(F.length(F.coalesce(content, F.lit(""))) >= GOOD_CONTENT) + points(F.coalesce(usage, F.lit(0)) > 0)
    ).cast("long")


def band(score: Column, high: float, middle: float) -> Column:
    return F.when(score >= high, "green").when(score >= middle, "yellow").otherwise("red")


def days_between(now: Column, then: Column) -> Column:
    """Whole days, rounded down, exact to the microsecond."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(now) - micros(then)) / F.lit(86_400_000_000)).cast("long")


def iso(c: Column) -> Column:
    """ISO text of a timestamp, with microseconds only where there are some."""
    micros = F.date_format(c, "SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language_of_path(path: Column, languages: dict[str, str] = SOURCE_LANGUAGES) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in languages.items() for x in pair]), extension(path))


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return F.contains(low, F.lit("test")) | F.contains(low, F.lit("spec"))


def display_language(content: Column) -> Column:
    """A language to highlight content by, from its first line and words. The words, and their order."""
    first = stripped(F.split_part(content, F.lit("\n"), F.lit(1)))
    low = F.lower(content)
    has = lambda *words: _any(content, words)
    bang = first.startswith("#!")
    said = lambda w: F.contains(first, F.lit(w))
    return (
        F.when(F.coalesce(content, F.lit("")) == "", "text")
        .when(bang & said("python"), "python").when(bang & (said("bash") | said("sh")), "bash").when(bang & said("ruby"), "ruby")
        .when(bang & said("node"), "javascript").when(bang & said("perl"), "perl")
        .when(has("def ", "import ", "class ") & (has("from ", "self") | said(":")), "python")
        .when(has("func ", "package "), "go")
        .when(has("function ", "const ", "let ") & has("=>", "require(", "export "), "javascript")
        .when(has("def ") & has("end") & has("do ", "|"), "ruby")
        .when(has("fn ") & has("let ") & has("::", "mut "), "rust")
        .when(_any(low, ("select ", "insert ", "update ", "delete ", "create table")), "sql")
        .when((left_stripped(content).startswith("---") | (has(": ") & has("  "))) & ~has("{") & ~has(";"), "yaml")
        .when(left_stripped(content).startswith("{") | left_stripped(content).startswith("["), "json")
        .when(first.startswith("$") | has("#!/", "export "), "bash")
        .otherwise("text")
    )


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def rendered(title: Column, score: Column | None, description: Column, tags: Column, content: Column | None, brief: Column | None = None) -> Column:
    """An entry as Markdown: with its content, or without one its brief; without a score no relevance."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    listed = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", ")
    parts = [F.concat(F.lit("### "), F.coalesce(title, F.lit("Untitled")))]
    if score is not None:
        parts.append(F.when(score.isNotNull(), F.concat(F.lit("*Relevance: "), F.format_string("%d%%", F.bround(score * 100).cast("int")), F.lit("*"))))
    parts += [F.when(full(description), F.concat(F.lit("\n"), description)), F.when(F.size(tags) > 0, F.concat(F.lit("\n**Tags:** "), listed))]
    if content is not None:
        parts.append(F.when(full(content), F.concat(F.lit("\n```\n"), content, F.lit("\n```"))))
    elif brief is not None:
        parts.append(F.when(full(brief), F.concat(F.lit("\n> "), brief)))
    return F.array_join(F.array_compact(F.array(*parts, F.lit(""))), "\n")


# Driver-side values


def since(text: str | None, now: datetime) -> str | None:
    """ISO text as it is; a number of days, weeks, months (30 days) or years (365) before now; else None."""
    if not text:
        return None
    try:
        datetime.fromisoformat(text)
        return text
    except ValueError:
        pass
    m = re.fullmatch(r"(\d+)([dwmy])", text.strip().lower())
    return (now - timedelta(days=int(m[1]) * {"d": 1, "w": 7, "m": 30, "y": 365}[m[2]])).isoformat() if m else None


def since_short(text: str, now: datetime) -> datetime | None:
    """A number of days or hours before now."""
    m = re.fullmatch(r"(\d+)([dh])", text.strip().lower())
    return now - timedelta(**{"days" if m[2] == "d" else "hours": int(m[1])}) if m else None


def path_code(path: str) -> str:
    return path.replace("/", "-")


def path_decode(code: str) -> str:
    """Back from path_code, as far as that can be told: a hyphen of the path has become a slash."""
    return code.replace("-", "/")


def machine() -> str:
    return socket.gethostname()
