"""A session with the settings this library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Joins and aggregations are re-planned at run time; small partitions are merged, skewed ones split.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app: str = "pulselake", **conf: str) -> SparkSession:
    """The running session, or a new one; further settings by name with ``_`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=CONF)
    return builder.config(map={k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
