"""Fuzzy tags without a comparison for each entry: a dictionary of the distinct tags by what is left of them after deletions.

Two words within two edits of each other have a word in common that each becomes by at most two deletions. The dictionary
holds these words of every distinct tag, so a wanted tag finds its neighbours by equality; the distance then decides for
each distinct tag once, and entries are found by the tags themselves. Tags of over LONG characters have too many such words:
they go by their length, and are compared with wanted tags of about that length."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits between a wanted tag and one found; characters of a tag that goes into the dictionary by its deletions.
EDITS, LONG = 2, 40


def left_after_deletions(word: str, most: int = EDITS) -> set[str]:
    return {"".join(c for i, c in enumerate(word) if i not in gone) for n in range(min(most, len(word)) + 1) for gone in combinations(range(len(word)), n)}


def _keys(tag: str) -> set[str]:
    """What a tag of the dictionary is found by."""
    return left_after_deletions(tag) if len(tag) <= LONG else {f"\0{len(tag)}"}


def _asked(tag: str) -> set[str]:
    """What a wanted tag looks for: its neighbours among tags of either kind."""
    short = left_after_deletions(tag) if len(tag) <= LONG + EDITS else set()
    return short | {f"\0{n}" for n in range(max(LONG + 1, len(tag) - EDITS), len(tag) + EDITS + 1)}


def build(entries: DataFrame, tags: str = "tags") -> DataFrame:
    """(key, tag): of each distinct tag, lower-cased, that entries have."""
    distinct = entries.select(F.explode(tags).alias("tag")).select(F.lower("tag").alias("tag")).where("tag is not null").distinct()

    def keyed(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            rows = [(k, t) for t in batch.column(0).to_pylist() for k in sorted(_keys(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in (0, 1)], names=["key", "tag"])

    return distinct.mapInArrow(keyed, "key string, tag string")


def neighbours(dictionary: DataFrame, wanted: list[str]) -> DataFrame:
    """(wanted, tag): the tags within EDITS edits of each wanted one."""
    spark = dictionary.sparkSession
    asked = spark.createDataFrame([(k, t.lower()) for t in wanted for k in sorted(_asked(t.lower()))], "key string, wanted string")
    # As many rows as the wanted tags have deletions.
    near = dictionary.join(F.broadcast(asked), "key").select("wanted", "tag").distinct()
    return near.where(F.levenshtein("wanted", "tag", EDITS) >= 0)


def tagged(entries: DataFrame, dictionary: DataFrame, wanted: list[str], tags: str = "tags") -> DataFrame:
    """Entries (id, ...) that for each wanted tag have one within EDITS edits of it."""
    wanted = sorted({t.lower() for t in wanted})
    if not wanted:
        return entries
    own = entries.select("id", F.explode(tags).alias("tag")).select("id", F.lower("tag").alias("tag"))
    found = own.join(neighbours(dictionary, wanted), "tag").groupBy("id").agg(F.countDistinct("wanted").alias("n")).where(F.col("n") == len(wanted))
    return entries.join(found, "id", "left_semi")
