"""A landing folder as a job queue: each new file is read once and merged idempotently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def drain(spark: SparkSession, folder: str, schema: StructType | str, checkpoint: str, merge: Callable[[DataFrame, int], None], fmt: str = "parquet") -> StreamingQuery:
    """Hand all files that are new since the last call to ``merge``; a batch may come again after a failure, so merge is to be idempotent."""
    rows = spark.readStream.schema(schema).format(fmt).load(folder)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by type and window of event time, with a watermark for late rows; timestamps without a zone count as UTC."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
