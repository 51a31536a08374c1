"""Version history of entries: numbering, pruning, rollback and differences."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_VERSIONS = 50


def numbered(images: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Images of entries with version_number, from 1 in order of time."""
    return images.withColumn("version_number", F.row_number().over(Window.partitionBy(key).orderBy(at, tie)).cast("long"))


def newest_version(versions: DataFrame, key: str) -> DataFrame:
    return versions.groupBy(key).agg(F.max("version_number").alias("version_number"), F.count("*").alias("n"))


def pruned(versions: DataFrame, key: str, most: int = MOST_VERSIONS) -> DataFrame:
    """The newest versions of each entry; the limit is applied before the shuffle too."""
    w = Window.partitionBy(key).orderBy(F.desc("version_number"))
    return versions.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def history(versions: DataFrame, key: str, value, limit: int | None = None) -> DataFrame:
    found = versions.where(F.col(key) == value).orderBy(F.desc("version_number"))
    return found.limit(limit) if limit is not None else found


def rolled_back(current: DataFrame, versions: DataFrame, key: str, version: int) -> DataFrame:
    """current with the fields of each entry's version of that number, where it has one."""
    fields = [c for c in current.columns if c != key and c in versions.columns]
    old = versions.where(F.col("version_number") == version).select(key, F.struct(*fields).alias("old"))
    joined = current.join(old, key, "left")
    return joined.select([F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns])


def changed_fields(versions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each version but the first with a flag for each field that differs from the one before; null equals null."""
    w = Window.partitionBy(key).orderBy("version_number")
    before = versions.withColumn("before", F.lag(F.struct(*fields)).over(w)).where("before is not null")
    return before.select(key, "version_number", *[(~F.col(f).eqNullSafe(F.col(f"before.{f}"))).alias(f"{f}_changed") for f in fields])


def diff_text(a: str | None, b: str | None, name_a: str = "before", name_b: str = "after") -> str | None:
    """A unified difference, a line for each of its lines; None if the texts are equal."""
    a, b = a or "", b or ""
    if a == b:
        return None
    return "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), name_a, name_b, lineterm=""))


def diff(versions: DataFrame, key: str, a: int, b: int, texts: list[str], flags: list[str]) -> DataFrame:
    """Differences between two versions of each entry: for texts a unified one, for flags whether they changed."""

    @F.pandas_udf("string")
    def unified(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([diff_text(p, q, f"v{a}", f"v{b}") for p, q in zip(x, y, strict=True)], dtype=object)

    left, right = (versions.where(F.col("version_number") == n).select(key, *[F.col(c).alias(f"{c}_{s}") for c in texts + flags]) for n, s in ((a, "a"), (b, "b")))
    both = left.join(right, key)
    return both.select(
        key, *[unified(f"{c}_a", f"{c}_b").alias(f"{c}_diff") for c in texts], *[(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{c}_changed") for c in flags]
    )
