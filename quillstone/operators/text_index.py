"""A stored index of trigrams: substring search reads the texts of candidates instead of all texts.

build() writes two tables: postings, a row for each trigram (three characters, A-Z folded, as one number) and entry that has
it, in buckets by trigram and sorted within; and the folded searchable texts, in parts by the entry's hash. A query's
trigrams are counted in their buckets, the rarest first; entries that have all of the few rarest are candidates, and their
texts, from the parts that hold them, decide. A query of fewer than three characters has no trigram and reads all texts.

Hits are exactly those of a full scan over what was indexed; changed() adds entries as they are now, whose older rows no
longer count."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scalars as S

#: Buckets of trigrams and parts of texts, for an index of its own size; rarest trigrams whose entries are intersected.
BUCKETS, PARTS, RAREST = 64, 64, 3
#: Candidates up to which the parts that hold them are chosen one by one.
FEW = 10_000
_SEPARATOR = "￿"
_ALL = (1 << 63) - 1


def grams_of(text: str) -> np.ndarray:
    """The distinct trigrams of a text, A-Z folded, as numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:]) if len(points) > 2 else np.zeros(0, dtype=np.int64)


class TextIndex:
    """The index at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads("".join(r[0] for r in spark.read.text(f"{self.path}/about").collect()))
        self.kind, self.buckets, self.parts = about["id"], about["buckets"], about["parts"]

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"gram long, id {self.kind}, seq long, bucket int").parquet(f"{self.path}/postings")

    @property
    def texts(self) -> DataFrame:
        """(id, seq, text, part): the greatest seq of an id counts."""
        return self.spark.read.schema(f"id {self.kind}, seq long, text string, part int").parquet(f"{self.path}/texts")

    def changed(self, entries: DataFrame) -> None:
        last = self.texts.agg(F.max("seq")).first()[0] or 0
        _write(entries, self.path, self.buckets, self.parts, last + 1, "append")

    def candidates(self, text: str) -> DataFrame | None:
        """(id): entries that may have text; None if its trigrams can't tell."""
        grams = grams_of(text).tolist()
        if not grams:
            return None
        # One number for each trigram of the query.
        bucket = F.array_distinct(F.transform(F.array(*[F.lit(g) for g in grams]), lambda g: _dealt(g, self.buckets)))
        buckets = self.spark.range(1).select(bucket).first()[0]
        found = self.postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        counts = {r["gram"]: r["count"] for r in found.groupBy("gram").count().collect()}
        if len(counts) < len(grams):
            return found.where("false").select("id")
        rare = sorted(counts, key=lambda g: (counts[g], g))[:RAREST]
        return found.where(F.col("gram").isin(rare)).groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(rare)).select("id")

    def hits(self, text: str) -> DataFrame:
        """(id): entries with text in one of the indexed columns."""
        if _SEPARATOR in text:
            return self.texts.where("false").select("id")
        near, texts = self.candidates(text), self.texts
        if near is not None:
            some = [r["id"] for r in near.limit(FEW + 1).collect()]
            if len(some) <= FEW:
                ids = self.spark.createDataFrame([(i,) for i in some], f"id {self.kind}")
                parts = [r["part"] for r in ids.select(_dealt(F.col("id"), self.parts).alias("part")).distinct().collect()]
                texts, near = texts.where(F.col("part").isin(parts)), F.broadcast(ids)
            texts = texts.join(near, "id", "left_semi")
        newest = texts.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("nth = 1")
        return newest.where(S.has_text(F.col("text"), text)).select("id")


def _dealt(column, parts: int):
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _write(entries: DataFrame, path: str, buckets: int, parts: int, seq: int, mode: str) -> None:
    joined = F.array_join(F.transform(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "content")]), S.ascii_lower), _SEPARATOR)
    texts = entries.where("id is not null").select("id", F.lit(seq).cast("long").alias("seq"), joined.alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def posted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                # What spans two columns is no trigram of either; it only makes a candidate more.
                grams = [grams_of(t) for t in part.column(1).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), part.column(0).take(rows)], names=["gram", "id"])

    postings = texts.select("id", "text").mapInArrow(posted, f"gram long, id {kind}").select("gram", "id", F.lit(seq).cast("long").alias("seq"), _dealt(F.col("gram"), buckets).alias("bucket"))
    # Trigrams that very many entries have make crowded buckets, which adaptive execution splits.
    postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    texts.withColumn("part", _dealt(F.col("id"), parts)).hint("rebalance", "part").write.mode(mode).partitionBy("part").parquet(f"{path}/texts")


def build(entries: DataFrame, path: str, buckets: int = BUCKETS, parts: int = PARTS) -> TextIndex:
    """Writes the index of entries (id, title, description, content) at path."""
    spark, path = entries.sparkSession, path.rstrip("/")
    _write(entries, path, buckets, parts, 1, "overwrite")
    about = json.dumps({"id": entries.schema["id"].dataType.simpleString(), "buckets": buckets, "parts": parts})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return TextIndex(spark, path)
