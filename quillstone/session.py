"""Session settings that every plan of this library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Values are in UTC; adaptive execution is left on so that partition counts follow the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession.Builder:
    """A session builder with SETTINGS; keyword names take "_" for "."."""
    made = SparkSession.builder.appName(app)
    if master:
        made = made.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        made = made.config(key, value)
    return made
