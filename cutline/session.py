"""A Spark session with the settings the package counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "cutline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; anything else is left to the cluster or given in ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
