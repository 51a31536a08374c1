"""A knowledge base made of the driver's tables, as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.tables import table

NOW = "2024-06-01 00:00:00"


def entries(spark: SparkSession, sf_dir: str, usage: bool = False, labels: bool = False) -> DataFrame:
    """Documents as entries. usage and labels join what they name; without them those columns are plain, and the
    tables aren't read."""
    d = table(spark, sf_dir, "documents")
    base = d.select(
        F.col("doc_id").alias("id"), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.concat("source", F.lit(" "), "lang", F.lit(" document")).alias("description"), F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"), F.col("source").alias("project"), F.lit(1.0).alias("confidence"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("created"), "n_chars",
    )
    base = base.withColumn("updated_at", F.col("created") + F.make_dt_interval((F.col("n_chars") % 60).cast("int"))).drop("n_chars")
    if labels:
        toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("toxic"))
        base = base.join(toxic, "id", "left").withColumn("tags", F.when(F.col("toxic"), F.array_append("tags", F.lit("toxic"))).otherwise(F.col("tags"))).drop("toxic")
    if usage:
        views = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("usage_count"), F.max("ts").alias("last_used"))
        return base.join(views, "id", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))
    return base.withColumns({"usage_count": F.lit(0).cast("long"), "last_used": F.lit(None).cast("timestamp_ntz")})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    row = vectors(spark, sf_dir).where(F.col("id") == vec_id).first()
    return [float(x) for x in row["embedding"]] if row else [1.0] + [0.0] * 63


#: The same entries for DuckDB.
SQL = """
WITH kb AS (
  SELECT d.doc_id AS id, left(split_part(d.text, chr(10), 1), 80) AS title, d.source || ' ' || d.lang || ' document' AS description, d.text AS content,
         CASE WHEN l.toxic = 1 THEN [d.lang, d.source, 'toxic'] ELSE [d.lang, d.source] END AS ltags, [d.lang, d.source] AS tags, d.source AS project,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INT)) AS created,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INT)) + to_days(CAST(d.n_chars % 60 AS INT)) AS updated_at,
         coalesce(u.n, 0) AS usage_count, u.last_used
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last_used FROM events WHERE event_type = 'view' GROUP BY user_id) u ON u.user_id = d.doc_id
)
"""
#: ISO text of a timestamp in DuckDB.
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END"
