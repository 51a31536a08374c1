"""How the sources of each language differ in their words: an audit by sharded SQL aggregation.

Every task counts the terms of its texts with DuckDB, in batches of bounded
size. Spark sums these counts and deals them to shards by the hash of language
and term; of a very common term a shard gets a row for each source. In a shard,
SQL keeps the terms of enough documents; totals over all shards give every
group's and language's shares of a term, and SQL then sums the differences of
shares for every two sources over the shard's terms, and finds the terms that
stand out most in each group. Spark merges these partial sums and rankings.

All numbers are integers: a share is in billionths, rounded down, of the count
with ``PRIOR`` added.

Defined cases: null text, lang and source are ''; a group whose texts have no
term has counts of zero, and a language without kept terms differs by 0;
repeated documents count each by itself; ties rank by the item's UTF-8 bytes; an
empty table gives no rows; only text, lang and source are read, so that further
columns clash with nothing; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: A kept term's documents in a language; what is added to each count; terms reported of a group.
LEAST_DOCUMENTS, PRIOR, TOP = 30, 5, 50
SCALE = 1_000_000_000
#: Bytes of text that one SQL statement counts, and kept counts in a shard.
BATCH_BYTES, SHARD_ROWS = 8_000_000, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

COUNT_SQL = f"""
with words as (select row, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) as term from docs),
by_document as (select row, lang, source, term, count(*) as n from words group by all)
select lang, source, term, sum(n)::bigint as n, count(*) as documents from by_document group by lang, source, term
"""
KEEP_SQL = """
with often as (select lang, term from counts group by lang, term having sum(documents) >= {least})
select lang, source, term, n from counts semi join often using (lang, term)
"""
#: counts: kept terms of the shard; groups: all groups with their totals.
SHARES_SQL = """
create or replace temp table shares as
with terms as (select lang, term, sum(n) as n from counts group by lang, term)
select g.lang, g.source, t.term, coalesce(c.n, 0) as n,
  (1 + ({scale}::hugeint * (coalesce(c.n, 0) + {prior})) // (g.total + {prior} * g.terms))::bigint as p,
  (1 + ({scale}::hugeint * (t.n + {prior})) // (g.lang_total + {prior} * g.terms))::bigint as q
from terms t join groups g using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = t.term
"""
PARTS_SQL = """
with halves as (
  select a.lang, a.source as one, b.source as other, sum(abs(a.p - b.p))::bigint as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all
), ranked as (
  select lang, source, term, p - q as value, row_number() over (partition by lang, source order by p - q desc, term) as nth from shares where n > 0 and p > q
)
select lang, one as source, 'pair' as part, other as item, value from halves
union all select lang, other, 'pair', one, value from halves
union all select lang, source, 'term', term, value from ranked where nth <= {top}
"""


def _database() -> duckdb.DuckDBPyConnection:
    """In memory, for one task: one thread, and no files beside Spark's."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"})


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    database = _database()
    for part in common.small_batches(batches, "text", BATCH_BYTES):
        database.register("docs", pa.Table.from_batches([common.extended(part, row=pa.array(np.arange(part.num_rows)))]))
        yield from database.sql(COUNT_SQL).to_arrow_reader(100_000)
        database.unregister("docs")


def _kept(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            database = _database()
            database.register("counts", pa.Table.from_batches(held))
            yield from database.sql(KEEP_SQL.format(least=least)).to_arrow_reader(100_000)

    return run


def audit(
    documents: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, prior: int = PRIOR, top: int = TOP, shards: int | None = None,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its others (part pair), and the
    terms that stand out in it (part term). shards: one for SHARD_ROWS counts, if not given."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = named.mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    # All of a term's counts in a language lie in one partition, where they are summed and the rare terms go.
    summed = counted.repartition(partitions, "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    kept = common.durable(summed.mapInArrow(_kept(least), "lang string, source string, term string, n long"))
    shards = shards or max(1, -(-kept.count() // SHARD_ROWS))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    groups = common.durable(
        named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])
    )

    def parts(counts: pa.Table, groups: pa.Table) -> pa.Table:
        if not counts.num_rows:
            return pa.table({n: pa.array([], pa.int64() if n == "value" else pa.string()) for n in ("lang", "source", "part", "item", "value")})
        database = _database()
        database.register("counts", counts)
        database.register("groups", groups)
        database.execute(SHARES_SQL.format(scale=SCALE, prior=prior))
        return database.sql(PARTS_SQL.format(top=top)).to_arrow_reader(100_000).read_all()

    by_shard = kept.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")).groupBy("shard")
    every_shard = groups.where("terms > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("shard")
    found = by_shard.cogroup(every_shard).applyInArrow(parts, "lang string, source string, part string, item string, value long")
    merged = common.durable(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    # The report itself has a row for every two sources of a language.
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = (
        groups.select("lang", "source").join(other, "lang").where("source <> item").withColumn("part", F.lit("pair"))
        .join(merged.where("part = 'pair'"), ["lang", "source", "part", "item"], "left").na.fill(0, ["value"])
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    terms = merged.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).select(columns).unionByName(terms.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


ORACLE = rf"""
with docs as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select row, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) as term from docs),
kept as (select lang, term, count(*) as n from words group by lang, term having count(distinct row) >= {LEAST_DOCUMENTS}),
counts as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
langs as (select lang, sum(n) as total, count(*) as v from kept group by lang),
groups as (select distinct lang, source from docs),
totals as (select lang, source, sum(n) as total from counts group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    (1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + {PRIOR})) // (coalesce(t.total, 0) + {PRIOR} * l.v))::bigint as p,
    (1 + ({SCALE}::hugeint * (k.n + {PRIOR})) // (l.total + {PRIOR} * l.v))::bigint as q
  from groups g join kept k using (lang) join langs l using (lang)
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term left join totals t on t.lang = g.lang and t.source = g.source
),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(v.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  ) v on v.lang = a.lang and v.source = a.source and v.item = b.source
  union all select lang, source, 'term', term, p - q from shares where n > 0 and p > q
),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP}
"""
