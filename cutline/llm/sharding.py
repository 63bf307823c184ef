"""Contiguous balanced shards from global prefix sums of byte sizes.

Rows are ordered by doc_id (nulls first), then by crc32 and size of the text. They are dealt out by ranges in that
order and written down slim; each range's total gives its place in the whole, a running sum within the range gives the
place of each row, and the whole is cut at equal targets: a row goes to the shard that holds its middle byte. Shards
are contiguous and their sizes differ from the target by at most the largest row.

A null text has no bytes; every row counts one byte besides its text, so empty texts have a place too. Rows equal in
all of doc_id, crc32 and size are interchangeable and get neighbouring slots. An empty table gives an empty result.
Only doc_id and text are read; other columns, whatever their names, can be joined by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

_ORDER = [F.asc_nulls_first, F.asc, F.asc]


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (0 to shards - 1), slot (0, 1, ... in each shard) and grown_shard (null) of each row."""
    spark = docs.sparkSession
    keys = ("doc_id", "text_crc32", "size")
    order = [f(k) for f, k in zip(_ORDER, keys, strict=True)]
    slim = docs.select(
        "doc_id",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
    )
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(slim.repartitionByRange(count, *order).withColumn("range", F.spark_partition_id()), "ranges")

    totals = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.select(*keys, "range", F.sum("size").over(within).alias("ending"), F.row_number().over(within).alias("nth")).join(starts, "range")
    placed = placed.withColumn("middle", 2 * (F.col("bytes_before") + F.col("ending")) - F.col("size"))
    shard = F.least(F.lit(shards - 1), F.expr(f"(cast(middle as decimal(38, 0)) * {shards}) div (2 * all_bytes)"))
    placed = stash(placed.select(*keys, shard.cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place")), "places")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
