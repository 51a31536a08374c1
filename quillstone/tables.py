"""Table access, and intermediate tables that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local session, as in tests, may name none; it gets a
    folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tables-")
    return _own["dir"]


def _filesystem(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def durable(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder; its lineage ends there. It is removed when the application ends, or by
    discard()."""
    spark = df.sparkSession
    application = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    path = f"{application}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if application not in _own:
        _own[application] = application
        folder, files = _filesystem(spark, application)
        files.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes a table of durable()'s that nothing reads any more."""
    files = table.inputFiles()
    if files:
        folder, system = _filesystem(table.sparkSession, files[0].rsplit("/", 1)[0])
        system.delete(folder, True)
