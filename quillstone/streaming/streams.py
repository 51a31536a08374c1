"""Usage and incremental mining as Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quillstone.operators import ledgers
from quillstone.tables import durable, shared_dir


def daily_usage(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(id, day, n) of views, finished once the watermark has passed a day."""
    # Times without a zone are read as UTC, whose days are the windows', whatever the session's zone is.
    at = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")
    views = events.where("event_type = 'view'").select(F.col("user_id").alias("id"), at.alias("at")).withWatermark("at", late)
    day = F.date_format(F.to_utc_timestamp("window.start", F.current_timezone()), "yyyy-MM-dd")
    return views.groupBy(F.window("at", "1 day"), "id").agg(F.count("*").alias("n")).select("id", day.alias("day"), "n")


def use_sessions(events: DataFrame, gap: str = "3 days", late: str = "2 days") -> DataFrame:
    """(id, first, last, n): runs of views with no longer pause than gap; an entry whose last run is over has gone stale.
    State is kept for open runs alone."""
    at = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")
    views = events.where("event_type = 'view'").select(F.col("user_id").alias("id"), at.alias("at")).withWatermark("at", late)
    runs = views.groupBy(F.session_window("at", gap), "id").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    shown = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias(c)
    return runs.select("id", shown("first"), shown("last"), "n")


_NEVER = -(1 << 62)


class _Staleness(StatefulProcessor):
    """Keeps an entry's latest use, and a timer for when it will have gone without one for too long."""

    def __init__(self, days: int):
        self.wait = days * 86_400_000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues):
        latest = max(int(frame["ms"].max()) for frame in rows)
        known = self.last.get()[0] if self.last.exists() else None
        if known is None or latest > known:
            if known is not None:
                self.handle.deleteTimer(known + self.wait)
            self.last.update((latest,))
            self.handle.registerTimer(latest + self.wait)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"id": [key[0]], "last": [pd.Timestamp(last, unit="ms")], "stale": [pd.Timestamp(last + self.wait, unit="ms")]})

    def close(self) -> None:
        pass


def stale_entries(events: DataFrame, days: int = 90, late: str = "2 days") -> DataFrame:
    """(id, last, stale): an entry that nobody has viewed for so many days, told once the watermark passes the time (stale),
    which needs no further event of its own. A later view begins anew. State is one time for each entry that isn't stale,
    in the RocksDB state store."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")
    timed = events.select(F.col("user_id").alias("id"), "event_type", at.alias("at")).withWatermark("at", late)
    # Rows that aren't views move the watermark on. A condition on the time as well can't be moved below it.
    ms = F.coalesce(F.when((F.col("event_type") == "view") & F.col("id").isNotNull(), F.unix_millis("at")), F.lit(_NEVER))
    views = timed.withColumn("ms", ms).where(F.col("ms") > _NEVER)
    return views.groupBy("id").transformWithStateInPandas(_Staleness(days), "id long, last timestamp_ntz, stale timestamp_ntz", "append", "eventTime")


def first_seen(events: DataFrame) -> DataFrame:
    """Each user's kinds of events once, by state, as changed files are told from those already processed."""
    return events.select(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).dropDuplicates(["id", "kind"])


def run_once(spark: SparkSession, path: str, made: Callable[[DataFrame], DataFrame], mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """What a stream over the files at path gives until it has read them all. Its state and results are in the shared
    folder. In mode update each batch holds the rows that it changed, and the last row of each of keys counts; in mode
    complete the last batch does."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(path) if not path.endswith(".parquet") else spark.readStream.schema(schema).option("pathGlobFilter", path.rsplit("/", 1)[1] if not _is_folder(spark, path) else "*").parquet(path if _is_folder(spark, path) else path.rsplit("/", 1)[0])
    out = made(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    found = spark.read.parquet(f"{at}/out")
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    elif mode == "update":
        rest = [c for c in out.columns if c not in keys]
        found = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
    return found.select(*out.columns)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def mined(items: DataFrame, key: tuple[str, ...], extract: Callable[[DataFrame], DataFrame], entries_path: str, ledger_path: str, checkpoint: str):
    """A stream that mines new items: those in the ledger are left out, entries are written, then items are marked. Each
    batch writes a folder of its own for either, which a batch that is run again after a loss replaces, and it doesn't look
    at its own marks: so nothing is repeated or left out. Of which item an entry was made is told by the key's columns in
    it, or by its source_refs, which hold the key's first column."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = f"{', '.join(f'{k} string' for k in key)}, processed_at timestamp_ntz, entries_created long, batch long"
        try:
            done = ledgers.current(spark.read.schema(schema).parquet(ledger_path).where(F.col("batch") != number).drop("batch"), key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], schema).drop("batch")
        todo = durable(ledgers.pending(batch, done, key))
        extract(todo).write.mode("overwrite").parquet(f"{entries_path}/batch={number}")
        made, which = spark.read.parquet(f"{entries_path}/batch={number}"), todo.select(*key).distinct()
        if not set(key) <= set(made.columns):
            made = made.select(F.explode("source_refs").alias(key[0])).join(which, key[0])
        ledgers.marks(which, key, made, datetime.now()).write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    return items.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step)
