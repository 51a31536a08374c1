r"""Chat formatting by prefix-target expansion, in SQL functions only.

Each assistant turn becomes an example of its own: all turns before it are
context, and only its text is trainable. A conversation that doesn't end with
an assistant turn has one more row, without a target, so that no turn is lost.
The template marks each turn as

    <s>[INST] role [/INST] text </s>

and a control string inside a role or a text (``<s> </s> [INST] [/INST]``, or
one already escaped) gets one more backslash after its first character, which
reading back removes.

An example holds all of its context, so a conversation's examples grow with the
square of its turns: ``full_text`` is all turns up to the target and the target.
Where storage must stay linear, expand(whole=False) gives rows without it that
hold the turns since the last target only; ``conv_id`` and ``part`` order them.

Defined cases: a null text or role is empty; rows are ordered by turn (null
first), ties by role, then text; repeated rows count each; rows of a null
conv_id form one conversation. A conversation's digest needs its whole text in
order, so one conversation is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HEAD, MIDDLE, TAIL = "<s>[INST] ", " [/INST] ", " </s>"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
#: One rendered turn; the groups are role and text.
_TURN = r"(?s)<s>\[INST\] (.*?) \[/INST\] (.*?) </s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _render(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), escape(turn["role"]), F.lit(MIDDLE), escape(turn["text"]), F.lit(TAIL))


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order."""
    filled = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    return filled.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def expand(conversations: DataFrame, *, whole: bool = True) -> DataFrame:
    """One row for each assistant turn (and for turns after the last): conv_id, part (int, from 0), context (the turns
    since the part before, rendered), header and footer (the target's markup), target (escaped; null without one).
    With whole, also full_text: all parts up to this one, and loss_start and loss_end, the code points of the target in it."""
    grouped = _turns(conversations).withColumn("rendered", F.transform("turns", _render))
    ends = F.filter(
        F.transform("turns", lambda t, i: F.when((t["role"] == "assistant") | (i == F.size("turns") - 1), i)), lambda i: i.isNotNull()
    )
    parts = grouped.withColumn("ends", ends).select("conv_id", "turns", "rendered", "ends", F.posexplode("ends").alias("part", "at"))
    first = F.when(F.col("part") == 0, 0).otherwise(F.expr("get(ends, part - 1)") + 1)
    last = F.expr("get(turns, at)")
    trained = last["role"] == "assistant"
    before = F.slice("rendered", first + 1, F.col("at") - first + F.when(trained, 0).otherwise(1))
    out = parts.select(
        "conv_id", "part", "rendered", "at",
        F.array_join(before, "").alias("context"),
        F.when(trained, F.concat(F.lit(HEAD), escape(last["role"]), F.lit(MIDDLE))).alias("header"),
        F.when(trained, escape(last["text"])).alias("target"),
        F.when(trained, F.lit(TAIL)).alias("footer"),
    )
    if not whole:
        return out.drop("rendered", "at")
    prefix = F.array_join(F.slice("rendered", F.lit(1), F.col("at") + F.when(F.col("target").isNull(), 1).otherwise(0)), "")
    out = out.withColumn("prefix", prefix)
    start = F.length("prefix") + F.length("header")
    return out.select(
        "conv_id", "part", "context", "header", "target", "footer",
        F.concat("prefix", F.coalesce(F.concat("header", "target", "footer"), F.lit(""))).alias("full_text"),
        start.alias("loss_start"), (start + F.length("target")).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """The digest of each conversation, from its whole examples alone: the last one's text, and what each trains on."""
    trained = F.expr("substring(full_text, loss_start + 1, loss_end - loss_start)")
    whole = examples.select("conv_id", "part", "full_text", F.struct("part", trained.alias("target")).alias("p"))
    joined = whole.groupBy("conv_id").agg(F.max_by("full_text", "part").alias("formatted"), F.array_sort(F.collect_list("p")).alias("parts")).select(
        "conv_id", "formatted",
        F.array_join(F.transform(F.filter("parts", lambda p: p["target"].isNotNull()), lambda p: unescape(p["target"])), "").alias("loss"),
    )
    roles, texts = F.regexp_extract_all("formatted", F.lit(_TURN), 1), F.regexp_extract_all("formatted", F.lit(_TURN), 2)
    said = F.zip_with(roles, texts, lambda r, t: F.concat(unescape(r), F.lit("\n"), unescape(t), F.lit("\n")))
    return joined.select(
        "conv_id", F.size(roles).cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation of control strings, which every run formats besides the table's.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(expand(with_probe(common.table(spark, sf_dir, "conversations"))))


_SQL_TURNS = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, regexp_replace(role, '([<\\[])(\\\\*)(/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g') AS erole,
            regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g') AS etext FROM rows
)
"""
ORACLE = _SQL_TURNS + """
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(erole) + length(etext) + 24) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
