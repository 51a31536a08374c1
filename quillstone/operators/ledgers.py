"""Ledgers of processed items: what is still to do, and marking it done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SESSION, COMMIT, FILE = ("session_id",), ("commit_sha", "repo_path"), ("file_path", "repo_path")


def pending(items: DataFrame, ledger: DataFrame, key: tuple[str, ...], content_hash: bool = False) -> DataFrame:
    """Items not in the ledger; with content_hash also those whose content has changed since."""
    return items.join(ledger, [*key, "content_hash"] if content_hash else list(key), "left_anti")


def current(marks: DataFrame, key: tuple[str, ...], at: str = "processed_at") -> DataFrame:
    """The latest mark of each key; marks are only appended."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), *[F.desc(c) for c in marks.columns if c not in key and c != at])
    return marks.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def marks(items: DataFrame, key: tuple[str, ...], created: DataFrame, at) -> DataFrame:
    """A mark for each item, with the number of entries created (key) from it."""
    n = created.groupBy(*key).agg(F.count("*").alias("entries_created"))
    hashes = ["content_hash"] if "content_hash" in items.columns else []
    return items.select(*key, *hashes).join(n, list(key), "left").select(*key, *hashes, F.lit(at).cast("timestamp_ntz").alias("processed_at"), F.coalesce("entries_created", F.lit(0)).cast("long").alias("entries_created"))
