"""Registered queries of the miners, readers, stores and scalars, run with their real rules.

The tables hold no transcripts, commits or source files, so each row of a table becomes one by a fixed recipe, and the SQL
states what must come out by the recipe alone."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import scalars as S
from quillstone.operators import code, commits, graph, ledgers, retrieval, search, sessions, versions
from quillstone.sources import readers
from quillstone.store import Engine
from quillstone.streaming import streams
from quillstone.tables import durable, shared_dir, table

from . import kb
from .catalog import _time, _with, registered

_INPUT = "struct<file_path:string,old_string:string,new_string:string,content:string,command:string>"


def _choice(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def _case(values: list[str], by: str) -> str:
    """The same choice in SQL."""
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values)) + " END"


# Transcripts: each order is a session of three pairs

_ASKED = ["How do I fix order {n}?", "Hi, could you please implement order {n} for me. Soon", "Thanks, that works", "That is still an error", "Order {n} arrived", "  help me with the long story of an order that goes on and on and on, further than any title should ever be allowed to go {n}"]
_TITLES = ["How do I fix order {n}", "Implement order {n} for me", "Thanks, that works", "That is still an error", "Order {n} arrived", "With the long story of an order that goes on and on and on, further than any..."]
_ANSWERS = ["Set the status of order {n} first.\n\nThen save it to the database.", "def order_{n}(x):\n    return x", "Done: order {n} is stored now."]


def _filled(text: Column, n: Column) -> Column:
    return F.replace(text, F.lit("{n}"), n.cast("string"))


def _asked_at(n: Column, pair: int) -> Column:
    return _filled(_choice(_ASKED, n + 2 * pair), n)


def _talks(spark, sf_dir) -> DataFrame:
    """Messages of sessions: pairs 0 to 2, answered by text, by an edit for every second order, by a command for every third."""
    n = F.col("o_orderkey")
    none = lambda t: F.lit(None).cast(t)

    def block(kind: str, text: Column | None = None, name: str | None = None, given: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("type"), (text if text is not None else none("string")).alias("text"), none("string").alias("id"), F.lit(name).cast("string").alias("name"), (given if given is not None else none(_INPUT)).alias("input"), none("array<string>").alias("result"))

    edit = F.struct(F.lit("a.py").alias("file_path"), F.lit("x").alias("old_string"), F.concat(F.lit("y"), n.cast("string")).alias("new_string"), none("string").alias("content"), none("string").alias("command"))
    command = F.struct(none("string").alias("file_path"), none("string").alias("old_string"), none("string").alias("new_string"), none("string").alias("content"), F.lit("make all").alias("command"))
    rows = []
    for pair in range(3):
        answer = F.array(block("text", _filled(_choice(_ANSWERS, n + pair), n)))
        answer = F.when(n % 2 == 0, F.concat(answer, F.array(block("tool_use", None, "Edit", edit)))).otherwise(answer)
        answer = F.when(n % 3 == 0, F.concat(answer, F.array(block("tool_use", None, "Bash", command)))).otherwise(answer)
        rows.append(F.struct(F.lit(2 * pair).cast("long").alias("seq"), F.lit("user").alias("type"), F.array(block("text", _asked_at(n, pair))).alias("blocks")))
        rows.append(F.struct(F.lit(2 * pair + 1).cast("long").alias("seq"), F.lit("assistant").alias("type"), answer.alias("blocks")))
    m = table(spark, sf_dir, "orders").select(n.cast("string").alias("session_id"), F.explode(F.array(*rows)).alias("m")).select("session_id", "m.*")
    return m.withColumns({"uuid": F.concat("session_id", F.lit("-"), "seq"), "timestamp": F.lit("2024-01-01").cast("timestamp")})


def _fill(text: str) -> str:
    return f"replace({text}, '{{n}}', n::VARCHAR)"


_TALKS = f"""WITH t AS (SELECT o_orderkey AS n, unnest([0, 1, 2]) AS pair FROM orders),
a AS (SELECT *, (n + 2 * pair) % 6 AS q, {_fill(_case(_TITLES, '(n + 2 * pair)'))} AS title, {_fill(_case(_ASKED, '(n + 2 * pair)'))} AS asked, {_fill(_case(_ANSWERS, '(n + pair)'))} AS answer, (n + pair) % 3 AS w FROM t),
f AS (SELECT *, bool_or(q = 2) OVER s AS ack, bool_or(q = 3) OVER s AS wrong FROM a WINDOW s AS (PARTITION BY n ORDER BY pair ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
c AS (SELECT *, CAST(40 + CASE WHEN n % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN n % 2 = 0 OR n % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN ack THEN 20 ELSE 0 END - CASE WHEN wrong THEN 15 ELSE 0 END AS INT) AS h FROM f)"""


@registered(_TALKS + " SELECT n::VARCHAR AS session_id, CAST(pair AS INT) AS pair, ack AS acknowledged, wrong AS corrected FROM c")
def conv_success_window(spark, sf_dir):
    found = sessions.with_outcome(sessions.conversation_pairs(_talks(spark, sf_dir)))
    return found.select("session_id", "pair", "acknowledged", "corrected")


@registered(_TALKS + " SELECT n::VARCHAR AS session_id, CAST(pair AS INT) AS pair, h AS hundredths FROM c")
def conv_confidence(spark, sf_dir):
    p = sessions.with_outcome(sessions.conversation_pairs(_talks(spark, sf_dir)))
    has_code = F.exists("tools", lambda t: t["name"].isin(*sessions.R.CODE_TOOLS))
    return p.select("session_id", "pair", sessions.confidence(has_code, F.size("tools") > 0, F.col("acknowledged"), F.col("corrected"), F.length("text")).alias("hundredths"))


@registered(_TALKS + " SELECT n::VARCHAR AS session_id, CAST(pair AS INT) AS pair, q IN (0, 1, 3, 5) AS question FROM c")
def question_gate(spark, sf_dir):
    p = sessions.conversation_pairs(_talks(spark, sf_dir))
    return p.select("session_id", "pair", sessions.matches(F.lower("user_text"), sessions.R.QUESTIONS).alias("question"))


_CONTENT = "answer || CASE WHEN n % 2 = 0 THEN chr(10) || chr(10) || chr(10) || 'Edit to a.py:' || chr(10) || '```' || chr(10) || 'y' || n || chr(10) || '```' ELSE '' END || CASE WHEN n % 3 = 0 THEN chr(10) || chr(10) || chr(10) || 'Command:' || chr(10) || '```bash' || chr(10) || 'make all' || chr(10) || '```' ELSE '' END"
_EXTRACTED = _TALKS + f""", e AS (SELECT *, {_CONTENT} AS content, [CASE WHEN w = 1 THEN 'python' END, CASE WHEN n % 3 = 0 THEN 'cli' END, CASE WHEN n % 2 = 0 THEN 'code' END, CASE WHEN w = 0 THEN 'database' END] AS tags FROM c WHERE q IN (0, 1, 3, 5) AND h >= 30)
SELECT n::VARCHAR AS session_id, title, CASE w WHEN 0 THEN 'Set the status of order ' || n || ' first.' ELSE answer END AS description, sha256(content) AS content_sha256,
  array_to_string(list_sort(list_filter(tags, lambda x: x IS NOT NULL)), ',') AS tags, h / 100.0::DOUBLE AS confidence, CASE WHEN n % 2 = 0 THEN 'problem_solution' ELSE 'general' END AS extraction_type, n || '-' || 2 * pair AS asked_in FROM e"""


def _entries(made: DataFrame) -> DataFrame:
    return made.select("session_id", "title", "description", F.sha2("content", 256).alias("content_sha256"), F.array_join("tags", ",").alias("tags"), "confidence", "extraction_type", F.col("source_refs")[0].alias("asked_in"))


@registered(_EXTRACTED)
def conv_extract(spark, sf_dir):
    """Title, description, content, tags, confidence and kind of each entry, and what it came from."""
    return _entries(sessions.extract(_talks(spark, sf_dir)))


@registered(_EXTRACTED + " WHERE n % 2 = 0 AND h >= 50")
def conv_problem_solutions(spark, sf_dir):
    return _entries(sessions.extract(_talks(spark, sf_dir), min_confidence=50, kinds=["problem_solution"]))


@registered("SELECT conv_id::VARCHAR AS session_id, CAST(turn AS BIGINT) AS seq, role AS type, sha256(coalesce(text, '')) AS text_sha256 FROM conversations WHERE role IN ('user', 'assistant')")
def session_files(spark, sf_dir):
    """Each conversation as a transcript of JSON lines among blank and malformed ones and those of other writers, read back."""
    c = table(spark, sf_dir, "conversations")
    said = F.to_json(F.struct(F.col("role").alias("type"), F.concat("conv_id", F.lit("-"), "turn").alias("uuid"), F.struct("role", F.coalesce("text", F.lit("")).alias("content")).alias("message")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("line")))), lambda x: x["line"]), "\n")
    text = c.groupBy("conv_id").agg(F.concat(lines, F.lit('\n\n{"type": "user", "mess\n{"type": "summary", "summary": "x"}\n')).alias("value"))
    files = durable(text)
    m = readers.messages(files, session=F.col("conv_id").cast("string"))
    w = sessions.Window.partitionBy("session_id").orderBy("seq")
    turns = c.where("role in ('user', 'assistant')").select(F.col("conv_id").cast("string").alias("session_id"), "turn", F.row_number().over(sessions.Window.partitionBy("conv_id").orderBy("turn")).alias("nth"))
    return m.withColumn("nth", F.row_number().over(w)).join(turns, ["session_id", "nth"]).select("session_id", F.col("turn").cast("long").alias("seq"), "type", F.sha2(sessions.text_content(F.col("blocks")), 256).alias("text_sha256"))


@registered("SELECT o_orderkey::VARCHAR AS session_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS modified FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') > '1997-01-01T00:00:00' ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 500")
def session_index_since(spark, sf_dir):
    """An index file of all orders, read with a date and a limit."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sessionId"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"))
    at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    o.select(F.struct("sessionId", "modified").alias("e")).withColumn("part", F.pmod(F.xxhash64("e"), F.lit(16))).groupBy("part").agg(F.collect_list("e").alias("entries")).write.partitionBy("part").json(at)  # one document a file
    found = readers.session_index(spark, at, "1997-01-01T00:00:00", 500)
    return found.select(F.col("sessionId").alias("session_id"), "modified")


@registered("""WITH RECURSIVE m AS (SELECT DISTINCT l_orderkey AS s, l_linenumber AS i, CASE WHEN l_linenumber % 3 = 1 THEN 'user' ELSE 'assistant' END AS type FROM lineitem), r AS (SELECT s, i, i AS root FROM m WHERE type = 'user'
  UNION ALL SELECT m.s, m.i, r.root FROM r JOIN m ON m.s = r.s AND m.i = r.i + 1 AND m.type = 'assistant')
SELECT s::VARCHAR AS session_id, CAST(row_number() OVER (PARTITION BY s ORDER BY root) - 1 AS INT) AS pair, s || '-' || root AS user_uuid, count(*) - 1 AS answers FROM r GROUP BY s, root HAVING count(*) > 1""")
def conv_threads(spark, sf_dir):
    """The lines of an order as messages, each below the one before: a thread ends at the next question."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_linenumber").cast("long").alias("seq")).distinct()
    kind = F.when(F.col("seq") % 3 == 1, "user").otherwise("assistant")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("seq").cast("string").alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("id", "name")], F.lit(None).cast(_INPUT).alias("input"), F.lit(None).cast("array<string>").alias("result")))
    m = l.withColumns({"uuid": F.concat("session_id", F.lit("-"), "seq"), "parent_uuid": F.concat("session_id", F.lit("-"), F.col("seq") - 1), "type": kind, "timestamp": F.lit("2024-01-01").cast("timestamp"), "blocks": block})
    return sessions.threaded_pairs(m).select("session_id", "pair", "user_uuid", F.size(F.split("text", "\n")).cast("long").alias("answers"))


_SNIPPETS = {"python": "import os", "javascript": "const a = 1", "typescript": "interface Shape", "go": "package main", "ruby": "def name", "rust": "fn main(", "bash": "ls the folder", "sql": "SELECT 1"}


@registered(f"SELECT o_orderkey AS id, {_case([*_SNIPPETS, ''], 'o_orderkey')} AS language FROM orders".replace("THEN ''", "THEN NULL"))
def mined_language(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("id"), sessions.code_language(F.concat(_choice([*_SNIPPETS.values(), "9 %"], n), F.lit(" "), n.cast("string"))).alias("language"))


@registered("SELECT o_orderkey AS id, CAST(2 AS INT) AS uses, CAST(1 AS INT) AS results, 'said' || chr(10) || o_orderkey || chr(10) || 'b' AS text FROM orders")
def message_blocks(spark, sf_dir):
    """Tool uses, tool results and text of messages as raw JSON."""
    n = F.col("o_orderkey").cast("string")
    content = F.concat(F.lit('[{"type":"text","text":"said"},{"type":"tool_use","id":"t1","name":"Edit","input":{}},{"type":"tool_use","id":"t2","name":"Bash","input":{"command":"ls"}},{"type":"tool_result","content":[{"type":"text","text":"'), n, F.lit('"},{"type":"image"},{"type":"text","text":"b"}]}]'))
    line = F.concat(F.lit('{"type":"user","uuid":"u","message":{"role":"user","content":'), content, F.lit("}}"))
    m = readers.messages(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("value")), session=n)
    return m.select(F.col("session_id").cast("long").alias("id"), F.size(sessions.tool_uses(F.col("blocks"))).alias("uses"), F.size(sessions.tool_results(F.col("blocks"))).alias("results"), sessions.text_content(F.col("blocks")).alias("text"))


# Commits: each order is one, its lines are the files it changes

_SUBJECTS = ["fix(auth): repair order {n}", "feat: add order {n}", "Improve performance of order {n}", "Refactor and move order {n}", "Order {n}", "docs: explain order {n}", "Merge branch {n}", "minor fix"]
_KINDS = ["bug_fix", "feature", "performance", "refactor", "general", "documentation", "general", "bug_fix"]
_HEADS = ["Fix: Repair order {n}", "Feature: Add order {n}", "Performance: Improve performance of order {n}", "Refactor and move order {n}", "Order {n}", "Explain order {n}", "Merge branch {n}", "Fix: Minor fix"]
_SAID = ["Bug fix", "New feature", "Performance improvement", "Code refactoring", "Code change", "Code change", "", ""]


def _diff(number: Column, tests: Column) -> Column:
    """One file's difference: the line's number of lines added, one taken away."""
    path = F.concat(F.when(tests, F.lit("tests/f")).otherwise(F.lit("src/api/f")), number.cast("string"), F.lit(".py"))
    plus = F.array_join(F.transform(F.sequence(F.lit(1), number.cast("int")), lambda i: F.concat(F.lit("+line "), i.cast("string"))), "\n")
    return F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nindex 1..2 100644\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,1 +1,2 @@ head\n-gone\n"), plus, F.lit("\n"))


def _records(spark, sf_dir) -> DataFrame:
    """The records that a log gives, fields parted by NUL."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))
    o = table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    n, zero = F.col("o_orderkey"), F.lit("\x00")
    message = F.concat(_filled(_choice(_SUBJECTS, n), n), F.when(n % 3 == 0, F.concat(F.lit("\n\nA body of order "), n.cast("string"), F.lit(" with words.\n\nMore of it."))).otherwise(""))
    diff = F.array_join(F.transform("lines", lambda x: _diff(x, x == 5)), "")
    return o.select(F.concat(F.sha2(n.cast("string"), 256), zero, F.lit("A"), zero, F.lit("a@b.c"), zero, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), zero, message, F.lit("\n"), zero, F.lit("\n\n"), diff).alias("value"))


def _log(spark, sf_dir) -> DataFrame:
    return commits.with_diffs(readers.commits(_records(spark, sf_dir)))


_LOG = f"""WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS lines FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS n, o_orderdate, sha256(o_orderkey::VARCHAR) AS sha, lines, o_orderkey % 8 AS k, {_fill(_case(_SUBJECTS, 'o_orderkey'))} AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 'A body of order ' || o_orderkey || ' with words.' ELSE '' END AS first,
  list_transform(lines, lambda x: CASE WHEN x = 5 THEN 'tests/f' ELSE 'src/api/f' END || x || '.py') AS paths, CAST(list_sum(lines) AS BIGINT) AS plus, len(lines) AS files
  FROM (SELECT *, o_orderkey AS n FROM orders) JOIN l ON l_orderkey = o_orderkey)"""


@registered(_LOG + " SELECT sha, 'A' AS author, 'a@b.c' AS author_email, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS timestamp, subject || CASE WHEN first <> '' THEN chr(10) || chr(10) || first || chr(10) || chr(10) || 'More of it.' ELSE '' END AS message, sha256(list_aggregate(list_transform(lines, lambda x: 'diff --git a/' || paths[list_position(lines, x)]), 'string_agg', ',')) AS heads FROM o")
def commit_records(spark, sf_dir):
    heads = F.array_join(F.transform(F.regexp_extract_all("diff", F.lit(r"(?m)^(diff --git a/\S+) b/"), 1), lambda x: x), ",")
    return readers.commits(_records(spark, sf_dir)).select("sha", "author", "author_email", _time("timestamp"), "message", F.sha2(heads, 256).alias("heads"))


@registered(_LOG + " SELECT sha, unnest(paths) AS file_path, 'modified' AS change_type, CAST(unnest(lines) AS INT) AS additions, CAST(1 AS INT) AS deletions, CAST(1 AS INT) AS old_start, CAST(2 AS INT) AS new_count, 'head' AS header FROM o")
def commit_diffs(spark, sf_dir):
    d = _log(spark, sf_dir).select("sha", F.explode("diffs").alias("d"))
    h = F.col("d.hunks")[0]
    return d.select("sha", "d.file_path", "d.change_type", "d.additions", "d.deletions", h["old_start"].alias("old_start"), h["new_count"].alias("new_count"), h["header"].alias("header"))


@registered(_LOG + " SELECT sha, plus AS additions, CAST(files AS BIGINT) AS deletions, list_contains(lines, 5) AS has_tests, 'python' AS languages FROM o")
def commit_totals(spark, sf_dir):
    return _log(spark, sf_dir).select("sha", commits.total(F.col("diffs"), "additions").alias("additions"), commits.total(F.col("diffs"), "deletions").alias("deletions"), F.exists("diffs", lambda d: S.is_test_path(d["file_path"])).alias("has_tests"), F.array_join(commits.languages(F.col("diffs")), ",").alias("languages"))


@registered(_LOG + " SELECT sha, subject, CASE WHEN first <> '' THEN first || chr(10) || chr(10) || 'More of it.' ELSE '' END AS body FROM o")
def commit_subject_body(spark, sf_dir):
    c = readers.commits(_records(spark, sf_dir))
    return c.select("sha", commits.subject(F.col("message")).alias("subject"), commits.body(F.col("message")).alias("body"))


@registered(f"SELECT o_orderkey AS id, {_case(['bug_fix', 'feature', 'performance', 'refactor', 'general', 'general', 'general', 'bug_fix'], 'o_orderkey')} AS kind FROM orders")
def classify_vote(spark, sf_dir):
    """By words alone, so that prefixes don't count."""
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("id"), commits.voted_kind(F.lower(_filled(_choice(_SUBJECTS, n), n))).alias("kind"))


_WORTH = f"""{_LOG}, c AS (SELECT *, {_case(_KINDS, 'n')} AS kind, {_fill(_case(_HEADS, 'n'))} AS title, {_case(_SAID, 'n')} AS said, CAST(30 + CASE WHEN k NOT IN (4, 6) THEN 15 ELSE 0 END + CASE WHEN k IN (0, 1, 5) THEN 5 ELSE 0 END + CASE WHEN first <> '' THEN 10 ELSE 0 END
  + CASE WHEN plus + files < 100 AND files < 5 THEN 10 ELSE 0 END + CASE WHEN list_contains(lines, 5) THEN 10 ELSE 0 END - CASE WHEN k = 7 THEN 10 ELSE 0 END AS INT) AS h FROM o WHERE k NOT IN (6, 7)),
e AS (SELECT *, CASE WHEN first <> '' THEN first ELSE said || ' affecting ' || array_to_string(paths[1:3], ', ') || CASE WHEN files > 3 THEN ', and ' || (files - 3) || ' more' ELSE '' END || ' (+' || plus || '/-' || files || ' lines).' END AS description,
  [CASE WHEN kind <> 'general' THEN replace(kind, '_', '-') END, CASE WHEN k = 0 THEN 'auth' END, 'python', CASE WHEN list_bool_or(list_transform(lines, lambda x: x <> 5)) THEN 'api' END, CASE WHEN list_contains(lines, 5) THEN 'tests' END] AS tags FROM c)"""


@registered(_WORTH + " SELECT sha, title, description, array_to_string(list_sort(list_distinct(list_filter(tags, lambda x: x IS NOT NULL)))[1:5], ',') AS tags, h / 100.0::DOUBLE AS confidence, kind AS extraction_type FROM e")
def commit_extract(spark, sf_dir):
    e = commits.extract(_log(spark, sf_dir))
    return e.select(F.col("source_refs")[0].alias("sha"), "title", "description", F.array_join("tags", ",").alias("tags"), "confidence", "extraction_type")


@registered(_WORTH + " SELECT sha, title FROM e WHERE kind IN ('bug_fix', 'feature') AND h >= 60")
def commit_identify(spark, sf_dir):
    """Bug fixes and features from a confidence on."""
    return commits.extract(_log(spark, sf_dir), 60, ["bug_fix", "feature"]).select(F.col("source_refs")[0].alias("sha"), "title")


_HUNK = "'-gone' || chr(10) || list_aggregate(list_transform(range(1, x + 1), lambda i: '+line ' || i), 'string_agg', chr(10))"


@registered(_WORTH + f""" SELECT sha, sha256('## Commit Message' || chr(10) || chr(10) || subject || CASE WHEN first <> '' THEN chr(10) || chr(10) || first || chr(10) || chr(10) || 'More of it.' ELSE '' END || chr(10)
  || chr(10) || chr(10) || '**Author:** A (a@b.c)' || chr(10) || '**Date:** ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || chr(10) || '**SHA:** ' || sha[1:8] || chr(10) || chr(10) || chr(10) || '## Files Changed' || chr(10) || chr(10)
  || list_aggregate(list_transform(lines, lambda x: '- [M] ' || paths[list_position(lines, x)] || ' (+' || x || '/-1)'), 'string_agg', chr(10)) || chr(10) || chr(10) || chr(10) || '## Key Changes' || chr(10) || chr(10)
  || list_aggregate(list_transform(lines[1:5], lambda x: chr(10) || '### ' || paths[list_position(lines, x)] || chr(10) || chr(10) || '```python' || chr(10) || {_HUNK} || chr(10) || '```' || chr(10)), 'string_agg', chr(10))) AS content_sha256 FROM e""")
def commit_content(spark, sf_dir):
    e = commits.extract(_log(spark, sf_dir))
    return e.select(F.col("source_refs")[0].alias("sha"), F.sha2("content", 256).alias("content_sha256"))


# Source files: each part is a Python file with a class

_ROLES = ["Repository", "Service", "Factory", "Widget", "Handler"]
_DOC = "Keeps the part named {p}, with all that belongs to it and more words than fifty characters.\n\nArgs:\n    x: a number"


def _sources(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey")
    role = _choice(_ROLES, n)
    path = F.concat(F.lit("src/f"), n.cast("string"), F.when(n % 4 == 0, "_repo.py").otherwise(".py"))
    doc = F.replace(F.lit(_DOC), F.lit("{p}"), F.col("p_name"))
    text = F.concat(
        F.lit("import os, sys\nfrom re import match\nimport json\n# TODO: check part "), n.cast("string"), F.lit("\n\n\n@cached\nclass P"), n.cast("string"), role, F.lit(':\n    """'), F.replace(doc, F.lit("\n"), F.lit("\n    ")),
        F.lit('\n    """\n\n    def find_all(self, x) -> int:\n        """Short."""\n        return x  # BUG: wrong\n\n    def get_one(self):\n        pass\n\n\ndef helper(a, b):\n    pass\n'),
    )
    # Rows of a few bytes become files: they are dealt to as many tasks as a shuffle has, before they grow.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.select(path.alias("path"), text.alias("content"), "p_partkey", "p_name")


def _parsed(spark, sf_dir) -> DataFrame:
    return code.parse(_sources(spark, sf_dir).select("path", "content"))


_FILES = f"""WITH p AS (SELECT p_partkey AS n, p_name, {_case(_ROLES, 'p_partkey')} AS role, 'src/f' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '_repo.py' ELSE '.py' END AS path,
  'Keeps the part named ' || p_name || ', with all that belongs to it and more words than fifty characters.' AS first FROM part),
f AS (SELECT *, first || chr(10) || chr(10) || 'Args:' || chr(10) || 'x: a number' AS doc, 'P' || n || role AS name FROM p)"""


@registered(_FILES + """ SELECT path, element_type, name, parent, signature, doc, start_line FROM (
  SELECT path, 'class' AS element_type, name, NULL AS parent, 'class ' || name || ':' AS signature, doc, CAST(8 AS INT) AS start_line FROM f
  UNION ALL SELECT path, 'method', 'find_all', name, 'def find_all(self, x)', 'Short.', 15 FROM f UNION ALL SELECT path, 'method', 'get_one', name, 'def get_one(self)', NULL, 19 FROM f
  UNION ALL SELECT path, 'function', 'helper', NULL, 'def helper(a, b)', NULL, 23 FROM f)""")
def code_elements(spark, sf_dir):
    e = _parsed(spark, sf_dir).select("path", F.explode("elements").alias("e"))
    return e.select("path", "e.element_type", "e.name", "e.parent", "e.signature", F.col("e.docstring").alias("doc"), "e.start_line")


@registered(_FILES + " SELECT path, 'python' AS language, 'json,os,re' AS imports, CAST(25 AS INT) AS line_count, '[TODO] check part ' || n || '|[BUG] wrong' AS comments, 'cached' AS decorators FROM f")
def code_files(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return p.select("path", "language", F.array_join(F.array_sort("imports"), ",").alias("imports"), F.col("line_count").cast("int").alias("line_count"), F.array_join("comments", "|").alias("comments"), F.array_join(F.flatten(F.transform("elements", lambda e: e["decorators"])), ",").alias("decorators"))


@registered(_FILES + """ SELECT path, 'Class: ' || name AS title, CASE WHEN length(first) > 200 THEN first[1:197] || '...' ELSE first END AS description,
  sha256('```python' || chr(10) || 'class ' || name || ':' || chr(10) || '```' || chr(10) || chr(10) || '## Documentation' || chr(10) || chr(10) || doc || chr(10) || chr(10) || '**File:** `' || split_part(path, '/', 2) || '` (line 8)' || chr(10) || chr(10) || '**Decorators:** `@cached`') AS content_sha256,
  'class,python,store' AS tags, CASE WHEN length(doc) > 100 THEN 0.65 ELSE 0.5 - CASE WHEN length(doc) < 100 THEN 0.1 ELSE 0 END END::DOUBLE AS confidence FROM f""")
def code_docstrings(spark, sf_dir):
    e = code.docstrings(_parsed(spark, sf_dir), "Store")
    return e.select(F.col("source_refs")[0].alias("path"), "title", "description", F.sha2("content", 256).alias("content_sha256"), F.array_join("tags", ",").alias("tags"), "confidence")


# A repository's class has find, get and all as method words (a half each) and its name (one); those of others only have its file's name.
_MATCHES = _FILES + """, m AS (SELECT path, n, name, 'repository' AS pattern_type, 1.5 + CASE WHEN role = 'Repository' THEN 1 ELSE 0 END + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS score FROM f)"""


@registered(_MATCHES + " SELECT pattern_type, path, name, least(1, score / 3)::DOUBLE AS confidence FROM m WHERE score >= 1.5")
def pattern_matches(spark, sf_dir):
    return code.pattern_matches(_parsed(spark, sf_dir)).where("pattern_type = 'repository'").select("pattern_type", "path", "name", "confidence")


@registered(_MATCHES + """, g AS (SELECT pattern_type, count(*) AS n, CAST(sum(round(6 * least(1, score / 3))) AS BIGINT) AS sixths, count(DISTINCT name) AS names FROM m GROUP BY 1)
SELECT pattern_type, n, sixths, false AS consistent, CAST(30 + 20 + CASE WHEN sixths > 3 * n THEN 10 ELSE 0 END AS INT) AS hundredths FROM g""")
def pattern_groups(spark, sf_dir):
    """The sum of confidences in sixths is a whole number, so no rounding stands between two engines."""
    m = durable(code.pattern_matches(_parsed(spark, sf_dir)).where("pattern_type = 'repository'"))
    sixths = m.groupBy("pattern_type").agg(F.sum(F.round(F.col("confidence") * 6)).cast("long").alias("sixths"))
    return code.pattern_groups(m).join(sixths, "pattern_type").select("pattern_type", "n", "sixths", "consistent", "hundredths")


@registered(_MATCHES + """, s AS (SELECT *, row_number() OVER (ORDER BY path) AS nth, count(*) OVER () AS n_all FROM m JOIN (SELECT path AS q, first, role FROM f) x ON x.q = m.path)
SELECT 'Repository Pattern' AS title, 'Data access layer abstraction for database operations. Found ' || any_value(n_all) || ' instances: ' || string_agg(name, ', ' ORDER BY nth) FILTER (nth <= 3) || ', and ' || (any_value(n_all) - 3) || ' more.' AS description,
  sha256('## Repository Pattern Instances' || chr(10) || chr(10) || string_agg(chr(10) || '### ' || name || chr(10) || chr(10) || '**File:** `' || split_part(path, '/', 2) || '`' || chr(10) || chr(10) || '**Evidence:**' || chr(10) || chr(10)
    || CASE WHEN role = 'Repository' THEN '- Name matches repository pattern' || chr(10) ELSE '' END || CASE WHEN n % 4 = 0 THEN '- File path matches repository pattern' || chr(10) ELSE '' END || '- Has find method' || chr(10) || '- Has get method' || chr(10) || '- Has all method' || chr(10)
    || chr(10) || '```python' || chr(10) || 'class ' || name || ':' || chr(10) || '```' || chr(10) || chr(10) || '_' || first || '_', chr(10) ORDER BY nth) FILTER (nth <= 5) || chr(10) || chr(10) || '_... and ' || (any_value(n_all) - 5) || ' more instances_') AS content_sha256, 'python,repository,store' AS tags, any_value(n_all) AS refs FROM s""")
def pattern_entry(spark, sf_dir):
    e = code.pattern_entries(_parsed(spark, sf_dir), "Store").where("title = 'Repository Pattern'")
    return e.select("title", "description", F.sha2("content", 256).alias("content_sha256"), F.array_join("tags", ",").alias("tags"), F.size("source_refs").cast("long").alias("refs"))


@registered(_FILES + """, c AS (SELECT path, mark, text, row_number() OVER (PARTITION BY mark ORDER BY path) AS nth, count(*) OVER (PARTITION BY mark) AS n_all FROM (SELECT path, 'TODO' AS mark, 'check part ' || n AS text FROM f UNION ALL SELECT path, 'BUG', 'wrong' FROM f))
SELECT 'Code ' || mark || 's' AS title, 'Found ' || any_value(n_all) || ' ' || mark || ' comments across the codebase.' AS description,
  sha256('## ' || mark || ' Comments' || chr(10) || chr(10) || string_agg('- `' || split_part(path, '/', 2) || '`: ' || text, chr(10) ORDER BY nth) FILTER (nth <= 20) || CASE WHEN any_value(n_all) > 20 THEN chr(10) || chr(10) || '_... and ' || (any_value(n_all) - 20) || ' more_' ELSE '' END) AS content_sha256,
  lower(mark) || ',store' AS tags, CASE WHEN mark = 'TODO' THEN 0.35 ELSE 0.45 END::DOUBLE AS confidence FROM c GROUP BY mark""")
def comment_entries(spark, sf_dir):
    e = code.comment_groups(_parsed(spark, sf_dir), "Store")
    return e.select("title", "description", F.sha2("content", 256).alias("content_sha256"), F.array_join("tags", ",").alias("tags"), "confidence")


@registered(_FILES + " SELECT extraction_type, count(*) AS n FROM (SELECT 'docstring' AS extraction_type FROM f UNION ALL SELECT 'pattern' UNION ALL SELECT unnest(['comment', 'comment'])) GROUP BY 1")
def code_extract(spark, sf_dir):
    """All three miners together; of patterns the repository's."""
    e = code.extract(_parsed(spark, sf_dir), "Store").where("extraction_type <> 'pattern' or title = 'Repository Pattern'")
    return e.groupBy("extraction_type").agg(F.count("*").alias("n"))


_NOTED = "text || chr(10) || '# TODO: check ' || doc_id || chr(10) || '// fixme later' || chr(10) || '/* NOTE this */'"


@registered(f"SELECT doc_id AS id, '[' || upper(regexp_extract(m, '(?i)(TODO|FIXME|NOTE|HACK|XXX|BUG|OPTIMIZE)', 1)) || '] ' || trim(regexp_replace(regexp_replace(m, '(?i)^(//|#|/\\*)\\s*(TODO|FIXME|NOTE|HACK|XXX|BUG|OPTIMIZE)\\s*:?\\s*', ''), '\\*/$', '')) AS comment FROM (SELECT doc_id, unnest(regexp_extract_all({_NOTED}, '(?im)(?://|#|/\\*)\\s*(?:TODO|FIXME|NOTE|HACK|XXX|BUG|OPTIMIZE)\\s*:?\\s*[^\\n]+?(?:\\*/)?$', 0)) AS m FROM documents) t")
def marker_comments(spark, sf_dir):
    noted = F.concat("text", F.lit("\n# TODO: check "), "doc_id", F.lit("\n// fixme later\n/* NOTE this */"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), noted.alias("content"))
    return d.select("id", F.explode(code.marked_comments(F.col("content"))).alias("comment"))


_TREE = {"python": "src/f{n}.py", "go": "cmd/main{n}.go", "javascript": "web/f{n}.min.js", "ruby": "vendor/f{n}.rb", "": "docs/f{n}.txt"}


@registered("SELECT CASE r_regionkey % 5 WHEN 0 THEN 'src/f' || r_regionkey || '.py' ELSE 'cmd/main' || r_regionkey || '.go' END AS path, sha256(r_name)[1:16] AS hash FROM region WHERE r_regionkey % 5 < 2")
def file_scan(spark, sf_dir):
    """A file for each region in a folder of its own kind, scanned without what is left out unless asked for, and of two languages."""
    at = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    for r in table(spark, sf_dir, "region").toLocalIterator():  # a handful
        readers.write_file(spark, f"{at}/{list(_TREE.values())[r['r_regionkey'] % 5].format(n=r['r_regionkey'])}", [r["r_name"]])
    return readers.source_files(spark, at, languages=["python", "go", "javascript", "ruby"]).select("path", S.file_hash(F.col("content")).alias("hash"))


# Stores


def _engine(spark) -> Engine:
    return Engine(spark, f"{shared_dir(spark)}/kb-{uuid.uuid4().hex}", now=lambda: datetime(2024, 6, 1))


def _stored(spark, sf_dir) -> Engine:
    """All documents as entries of a store; every fifth updated, every seventh deleted."""
    engine = _engine(spark)
    e = kb.entries(spark, sf_dir).withColumns({"id": F.concat(F.lit("e"), F.col("id").cast("string")), "n": F.col("id"), "brief": F.lit(None).cast("string"), "context": F.array().cast("array<string>"), "source": F.lit("table")})
    engine.store.append("entries", e)
    engine.store.append("entries", e.where("n % 5 = 0").withColumn("title", F.concat(F.lit("New "), F.col("n").cast("string"))))
    engine.store.append("entries", e.where("n % 7 = 0"), "delete")
    return engine


@registered(_with("SELECT 'e' || id AS id, CASE WHEN id % 5 = 0 THEN 'New ' || id ELSE title END AS title, project FROM kb WHERE id % 7 <> 0"))
def store_current(spark, sf_dir):
    """Inserts, updates and deletions in a log; the last image of each key counts."""
    return _stored(spark, sf_dir).entries().select("id", "title", "project")


@registered(_with("SELECT title, count(*) AS entries, count(DISTINCT content) AS texts FROM kb WHERE trim(title, chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND trim(content, chr(32) || chr(9) || chr(10) || chr(13)) <> '' GROUP BY title"))
def store_capture(spark, sf_dir):
    """All documents captured at once: titles repeat, and so do whole texts, but none is lost."""
    engine, e = _engine(spark), kb.entries(spark, sf_dir).drop("id")
    engine.capture_all(e.where(readers.valid(e)))
    return engine.entries().groupBy("title").agg(F.count("*").alias("entries"), F.countDistinct("content").alias("texts"))


@registered(_with("SELECT 'e' || id AS id FROM kb WHERE id % 7 = 0"))
def store_tombstones(spark, sf_dir):
    return _stored(spark, sf_dir).tombstones().select("id")


@registered(_with("SELECT count(*) AS purged, (SELECT count(*) FROM kb WHERE id % 7 <> 0 AND project <> 'src3') AS kept FROM kb WHERE id % 7 <> 0 AND project = 'src3'"))
def store_purge(spark, sf_dir):
    engine = _stored(spark, sf_dir)
    n = engine.purge("src3")
    return engine.entries().agg(F.lit(n).cast("long").alias("purged"), F.count("*").alias("kept"))


@registered(_with("SELECT 'e' || id AS id, title, content, array_to_string(tags, ',') AS tags, strftime(created, '%Y-%m-%d %H:%M:%S') AS created FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'New ' || id ELSE title END AS title, content, tags, created FROM kb WHERE id % 7 <> 0) k WHERE trim(title, chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND trim(content, chr(32) || chr(9) || chr(10) || chr(13)) <> ''"))
def store_export_import(spark, sf_dir):
    """What one store exports, another imports: ids, tags and times come back."""
    engine, other, at = _stored(spark, sf_dir), _engine(spark), f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    engine.export(at)
    other.import_from(at)
    return other.entries().select("id", "title", "content", F.array_join("tags", ",").alias("tags"), _time("created"))


@registered(_with("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN id % 3 = 0 OR trim(content, chr(32) || chr(9) || chr(10) || chr(13)) = '' OR trim(title, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'error' WHEN id % 2 = 0 THEN 'skipped' ELSE 'imported' END AS outcome FROM kb) GROUP BY 1"))
def import_outcomes(spark, sf_dir):
    e = kb.entries(spark, sf_dir)
    told = readers.classified(e.withColumn("description", F.when(F.col("id") % 3 == 0, F.lit(" \n\t")).otherwise(F.col("description"))), e.where("id % 2 = 0").select("id"))
    return told.groupBy("outcome").agg(F.count("*").alias("n"))


@registered("SELECT o_custkey AS collection_id, o_orderkey AS entry_id FROM orders WHERE o_orderkey % 2 = 1")
def add_members(spark, sf_dir):
    """Inserting memberships, those that are there already ignored."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("entry_id"), F.lit(0).alias("added_at"))
    return graph.add_members(wanted.where("entry_id % 2 = 0"), wanted).select("collection_id", "entry_id")


@registered("SELECT o_orderkey AS source_id, o_custkey AS target_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"))
    return graph.cascade(edges, gone, "source_id", "target_id")


@registered("SELECT o_orderkey AS source_id, o_custkey AS target_id, 'related' AS relationship_type FROM orders WHERE NOT (o_orderkey = 7 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7))")
def unlink(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"), F.lit("related").alias("relationship_type"))
    end = edges.where("source_id = 7").first()
    return graph.unlink(edges, end["target_id"] if end else -1, 7, "related")


@registered("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 17 OR o_orderkey = 17")
def entry_relationships(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"))
    return graph.between_entries(edges, 17).select("id")


@registered("SELECT n_name AS id, CASE n_nationkey % 4 WHEN 0 THEN 'push' WHEN 1 THEN 'no_change' WHEN 2 THEN 'pull' ELSE 'conflict' END AS action FROM nation")
def sync_folder(spark, sf_dir):
    """Two stores and a folder of documents: what one has edited since, or the other, or both, against what was agreed."""
    a, b, folder = _engine(spark), _engine(spark), f"{shared_dir(spark)}/replica-{uuid.uuid4().hex}"
    n = F.col("n_nationkey")
    e = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_name").alias("title"), F.lit("d").alias("description"), F.lit("c").alias("content"), n, F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    a.store.append("entries", a.embed(e))
    a.sync(folder)
    b.sync(folder)
    b.store.append("entries", b.embed(e.where(n % 4 >= 2).withColumn("content", F.lit("of b"))))
    b.sync(folder)
    a.store.append("entries", a.embed(e.where((n % 4 == 0) | (n % 4 == 3)).withColumn("content", F.lit("of a"))))
    return a.sync(folder, strategy="manual", dry_run=True).select("id", "action")


@registered("""SELECT side, c_name AS id, CASE WHEN c_custkey % 5 = 1 THEN 'of b' WHEN c_custkey % 5 = 4 THEN 'of a' ELSE 'c' END AS content
FROM customer, (SELECT unnest(['a', 'b', 'folder']) AS side) WHERE c_custkey % 5 NOT IN (2, 3)""")
def sync_applied(spark, sf_dir):
    """Two stores and a folder after edits on either side were pushed and pulled, and deletions on either side reached all."""
    a, b, folder = _engine(spark), _engine(spark), f"{shared_dir(spark)}/replica-{uuid.uuid4().hex}"
    n = F.col("c_custkey") % 5
    # Dealt to tasks before their texts are embedded: the table's file may be read by one.
    dealt = table(spark, sf_dir, "customer").select("c_name", "c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    e = dealt.select(F.col("c_name").alias("id"), F.col("c_name").alias("title"), F.lit("d").alias("description"), F.lit("c").alias("content"), "c_custkey", F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    a.store.append("entries", a.embed(e))
    a.sync(folder)
    b.sync(folder)
    b.store.append("entries", b.embed(e.where(n == 1).withColumn("content", F.lit("of b"))))
    a.store.append("entries", a.embed(e.where(n == 4).withColumn("content", F.lit("of a"))))
    a.store.append("entries", e.where(n == 2), "delete", a.now())
    b.store.append("entries", e.where(n == 3), "delete", b.now())
    for one in (b, a, b):
        one.sync(folder)
    told = {"a": a.entries(), "b": b.entries(), "folder": readers.replica(spark, folder, "entries", readers.ENTRY)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(side).alias("side"), "id", "content") for side, df in told.items()])


@registered("SELECT n_name AS id, 'pull' AS action FROM nation WHERE n_nationkey % 2 = 1")
def sync_status(spark, sf_dir):
    """Against the folder's manifest: another store pushed its edits; the rest is agreed."""
    a, b, folder = _engine(spark), _engine(spark), f"{shared_dir(spark)}/replica-{uuid.uuid4().hex}"
    n = F.col("n_nationkey")
    e = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_name").alias("title"), F.lit("d").alias("description"), F.lit("c").alias("content"), n, F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    a.store.append("entries", a.embed(e.where(n % 2 == 0)))
    b.store.append("entries", b.embed(e))
    a.sync(folder)
    b.sync(folder)
    return a.sync_status(folder)


@registered("SELECT o_orderkey::VARCHAR AS commit_sha, CASE WHEN o_orderkey % 2 = 0 THEN 'marked' ELSE 'pending' END AS state, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 ELSE 0 END AS BIGINT) AS entries_created FROM orders")
def ledger_marks(spark, sf_dir):
    """Marks in a store's ledger, with the number of entries made, and what is still to do."""
    engine, n = _engine(spark), F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(n.cast("string").alias("commit_sha"), F.lit("r").alias("repo_path"), n)
    made = items.where(n % 2 == 0).select("commit_sha", "repo_path", F.explode(F.sequence(F.lit(0), (n % 3).cast("int"))).alias("i")).where("i > 0")
    engine.mark("commits", items.where(n % 2 == 0), made)
    done = engine.processed("commits").select("commit_sha", F.lit("marked").alias("state"), "entries_created")
    return done.unionByName(engine.pending("commits", items).select("commit_sha", F.lit("pending").alias("state"), F.lit(0).cast("long").alias("entries_created")))


@registered(_with("SELECT id FROM kb WHERE starts_with(CAST(id AS VARCHAR), '1') ORDER BY coalesce(last_used, created) DESC NULLS LAST, id LIMIT 50"))
def complete_id(spark, sf_dir):
    e = kb.entries(spark, sf_dir, usage=True).withColumn("n", F.col("id")).withColumn("id", F.col("id").cast("string"))
    found = e.where(F.col("id").startswith("1")).orderBy(F.desc_nulls_last(F.coalesce("last_used", "created")), "n").limit(50)
    same = search.complete(e.drop("n"), "id", "1")
    return found.join(same, "id", "left_semi").select(F.col("id").cast("long").alias("id"))


# Scalars


@registered("WITH t AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'Hello, ' WHEN 1 THEN 'Could you please ' ELSE '' END || 'tell ' || lang || ' ' || source || ' ' || repeat('word ', CAST(doc_id % 30 AS INT)) || 'end. And more' AS s, 'tell ' || lang || ' ' || source || ' ' || repeat('word ', CAST(doc_id % 30 AS INT)) || 'end' AS f FROM documents) SELECT id, upper(f[1]) || CASE WHEN length(f) <= 80 THEN f[2:] ELSE (CASE WHEN instr(reverse(f[1:77]), ' ') > 0 AND 77 - instr(reverse(f[1:77]), ' ') > 40 THEN f[2:(77 - instr(reverse(f[1:77]), ' '))] ELSE f[2:77] END) || '...' END AS title FROM t")
def title_gen(spark, sf_dir):
    n = F.col("doc_id")
    asked = F.concat(_choice(["Hello, ", "Could you please ", ""], n), F.lit("tell "), "lang", F.lit(" "), "source", F.lit(" "), F.repeat(F.lit("word "), (n % 30).cast("int")), F.lit("end. And more"))
    return table(spark, sf_dir, "documents").select(n.alias("id"), sessions.title(asked).alias("title"))


_SHOWN = "'### ' || title || chr(10) || '*Relevance: ' || CAST(id % 100 AS VARCHAR) || '%*' || chr(10) || chr(10) || description || chr(10) || chr(10) || '**Tags:** `' || tags[1] || '`, `' || tags[2] || '`' || chr(10) || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10)"


@registered(_with(f"SELECT id, CASE WHEN content = '' THEN replace({_SHOWN}, chr(10) || chr(10) || '```' || chr(10) || chr(10) || '```', '') ELSE {_SHOWN} END AS shown FROM kb"))
def render_entries(spark, sf_dir):
    e = kb.entries(spark, sf_dir)
    return e.select("id", S.rendered(F.col("title"), (F.col("id") % 100) / 100.0, F.col("description"), F.col("tags"), F.col("content")).alias("shown"))


@registered(_with("SELECT id, '### ' || title || chr(10) || chr(10) || description || chr(10) || chr(10) || '**Tags:** `' || tags[1] || '`, `' || tags[2] || '`' || chr(10) || chr(10) || '> ' || project || chr(10) AS shown FROM kb"))
def render_briefs(spark, sf_dir):
    e = kb.entries(spark, sf_dir)
    return e.select("id", S.rendered(F.col("title"), None, F.col("description"), F.col("tags"), None, F.col("project")).alias("shown"))


@registered(_with(f"SELECT '## Retrieved Knowledge' || chr(10) || chr(10) || string_agg({_SHOWN}, chr(10) ORDER BY id) AS text FROM (SELECT * FROM kb WHERE content <> '' ORDER BY id LIMIT 20)"))
def render_context(spark, sf_dir):
    """The first twenty entries as the text that a prompt would hold."""
    e = kb.entries(spark, sf_dir).where("content <> ''").orderBy("id").limit(20)
    return retrieval.context(e.withColumns({"rank": F.col("id"), "score": (F.col("id") % 100) / 100.0}))


_FACES = ["#!/usr/bin/env python", "#!/bin/bash", "#!/usr/bin/ruby", "#!/usr/bin/env node", "#!/usr/bin/perl", "import os\nfrom x", "package main", "const a = () => 1", "fn main() { let x: std::y; }", "select 1", "\n\t---\nx", " \n[1]", "$ ls", "plain", ""]
_SHOWN_AS = ["python", "bash", "ruby", "javascript", "perl", "python", "go", "javascript", "rust", "sql", "yaml", "json", "bash", "text", "text"]


@registered(f"SELECT o_orderkey AS id, {_case(_SHOWN_AS, 'o_orderkey')} AS language FROM orders")
def display_language(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("id"), S.display_language(_choice(_FACES, n)).alias("language"))


@registered(_with("SELECT id, title || '. ' || description || '. ' || content AS text FROM kb"))
def embedding_text(spark, sf_dir):
    return kb.entries(spark, sf_dir).select("id", S.embedding_text(F.col("title"), F.col("description"), F.col("content")).alias("text"))


@registered("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 101 >= 70 THEN 'green' WHEN o_orderkey % 101 >= 40 THEN 'yellow' ELSE 'red' END AS band FROM orders")
def score_bands(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.band(F.col("o_orderkey") % 101, 70, 40).alias("band"))


@registered("SELECT doc_id AS id, length(embedding_words) > 0 AS some FROM (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS embedding_words FROM documents)")
def embedded_entries(spark, sf_dir):
    """Every entry with words gets a vector of unit length."""
    e = kb.entries(spark, sf_dir).select("id", F.lit("").alias("title"), F.lit("").alias("description"), "content")
    return readers.embedded(e).select("id", (F.round(S.norm(F.col("embedding")), 3) == 1).alias("some"))


@registered("SELECT * FROM (VALUES ('2w', '2024-05-18T00:00:00'), ('3d', '2024-05-29T00:00:00'), ('1m', '2024-05-02T00:00:00'), ('1y', '2023-06-02T00:00:00'), ('2024-01-05', '2024-01-05'), ('x', NULL), ('short 36h', '2024-05-30T12:00:00'), ('short 2d', '2024-05-30T00:00:00'), ('short 2w', NULL), ('path', '-a-b'), ('back', '/a/b'), ('repo', 'name'), ('repo ssh', 'name')) t(said, value)")
def driver_values(spark, sf_dir):
    """What is worked out before a plan: dates, path names and a repository's name."""
    now = datetime(2024, 6, 1)
    short = lambda t: (lambda d: d.isoformat() if d else None)(S.since_short(t, now))
    rows = [(t, S.since(t, now)) for t in ("2w", "3d", "1m", "1y", "2024-01-05", "x")] + [(f"short {t}", short(t)) for t in ("36h", "2d", "2w")]
    rows += [("path", S.path_code("/a/b")), ("back", S.path_decode("-a-b")), ("repo", readers.repo_name("https://h/u/name.git")), ("repo ssh", readers.repo_name("git@h:u/name.git"))]
    return spark.createDataFrame(rows, "said string, value string")


@registered("SELECT n_nationkey AS id, '-' || n_name AS gone, '+' || n_comment AS came FROM (SELECT n_nationkey, n_name, r_name AS n_comment FROM nation JOIN region ON r_regionkey = n_regionkey)")
def unified_diffs(spark, sf_dir):
    """The last two lines of a difference of one-line texts."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    v = n.select(F.col("n_nationkey").alias("id"), F.explode(F.array(F.struct(F.lit(1).alias("version_number"), F.col("n_name").alias("text")), F.struct(F.lit(2).alias("version_number"), F.col("r_name").alias("text")))).alias("v")).select("id", "v.*")
    lines = F.split("text_diff", "\n")
    return versions.diff(v, "id", 1, 2, ["text"], []).select("id", lines[3].alias("gone"), lines[4].alias("came"))


# Streams


@registered("""WITH v AS (SELECT user_id AS id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 DAY THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type = 'view'),
r AS (SELECT id, ts, sum(fresh) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM v)
SELECT id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM r GROUP BY id, run""")
def usage_runs(spark, sf_dir):
    """Runs of use by session windows: an entry without one of late is stale."""
    return streams.run_once(spark, f"{sf_dir}/events.parquet", streams.use_sessions, "complete")


@registered("""SELECT user_id AS id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, strftime(max(ts) + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS stale FROM events WHERE event_type = 'view' GROUP BY user_id
HAVING max(ts) + INTERVAL 3 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stale_stream(spark, sf_dir):
    """Entries turn stale by timers, when the watermark passes them, without an event of their own."""
    found = streams.run_once(spark, f"{sf_dir}/events.parquet", lambda df: streams.stale_entries(df, days=3))
    return found.select("id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("last", "stale")])


@registered("SELECT event_type AS path, strftime(max(ts), '%Y-%m-%d') AS day, CAST(1 AS BIGINT) AS entries_created FROM events GROUP BY 1")
def mining_stream(spark, sf_dir):
    """Items that come in again and again are mined once, over two runs of the stream; entries are keyed by source_refs."""
    at = f"{shared_dir(spark)}/mined-{uuid.uuid4().hex}"
    kinds = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("file_path")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("day")).withColumn("repo_path", F.lit("r"))
    extract = lambda df: df.dropDuplicates(["file_path"]).select(F.col("day").alias("title"), F.array("file_path").alias("source_refs"))
    for _ in range(2):
        kinds.write.mode("append").parquet(f"{at}/in")
        items = spark.readStream.schema("file_path string, day string, repo_path string").parquet(f"{at}/in")
        streams.mined(items, ledgers.FILE, extract, f"{at}/entries", f"{at}/ledger", f"{at}/state").start().awaitTermination()
    marks = ledgers.current(spark.read.parquet(f"{at}/ledger").drop("batch"), ledgers.FILE)
    entries = spark.read.parquet(f"{at}/entries").select(F.col("source_refs")[0].alias("file_path"), F.col("title").alias("day"))
    return entries.join(marks, "file_path").select(F.col("file_path").alias("path"), "day", "entries_created")
