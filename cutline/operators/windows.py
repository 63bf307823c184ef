"""Window operators: ranks, islands, deltas, best and runner-up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark cuts each group before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def dealt(df: DataFrame, by: Sequence[str], rows: int = 500_000) -> DataFrame:
    """Rows dealt by key to as many tasks as leave each about ``rows`` of them, so that a task's memory doesn't grow with the table.

    What is grouped or ordered within these keys next needs no other shuffle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *by)


def islands(df: DataFrame, by: Sequence[str], at: str, gap: Column | float, out: str = "island") -> DataFrame:
    """Number the runs of rows whose distance to the row before is at most ``gap``, from 1."""
    window = Window.partitionBy(*by).orderBy(at)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(window)) > gap, F.lit(True)).cast("int")
    return df.withColumn("__fresh", fresh).withColumn(out, F.sum("__fresh").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def anchored_numbers(df: DataFrame, by: Sequence[str], at: str, reach: float, out: str = "cluster") -> DataFrame:
    """Number, from 1, the clusters whose members lie within ``reach`` of their first: by, at (double), out.

    Rows stream past in order with the first member in memory, so a large group costs no more a row than a small one.
    """
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, n = None, 0.0, 0
        for batch in batches:
            numbers = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and row[:-1] == group:
                    if row[-1] - first > reach:
                        first, n = row[-1], n + 1
                else:
                    group, first, n = row[:-1], row[-1], 1
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*by, at, out])

    rows = df.where(F.col(at).isNotNull()).select(*by, F.col(at).cast("double").alias(at))
    return rows.repartition(*by).sortWithinPartitions(*by, at).mapInArrow(number, f"{', '.join(kinds)}, {at} double, {out} long")


def anchored_clusters(df: DataFrame, by: Sequence[str], at: str, reach: float) -> DataFrame:
    """Clusters whose members lie within ``reach`` of the first: by, clusters (array of arrays)."""
    each = anchored_numbers(df, by, at, reach, "__n").groupBy(*by, "__n").agg(F.sort_array(F.collect_list(at)).alias("__v"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__v"))), lambda c: c["__v"]).alias("clusters"))


def number_ranges(df: DataFrame, by: Sequence[str], number: str, out: str = "spec") -> DataFrame:
    """Runs of consecutive numbers as text such as ``1-3,7``."""
    window = Window.partitionBy(*by).orderBy(number)
    runs = df.select(*by, number).distinct().withColumn("__run", F.col(number) - F.row_number().over(window))
    ends = runs.groupBy(*by, "__run").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    listed = ends.select(*by, F.struct("a", text.alias("t")).alias("r")).groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return listed.select(*by, F.array_join(F.transform("rs", lambda r: r["t"]), ",").alias(out))


def delta_band(df: DataFrame, by: Sequence[str], period: str, value: str, band: str) -> DataFrame:
    """Difference to the nearest earlier period, and same / up / down by a band given as decimal text."""
    window = Window.partitionBy(*by).orderBy(period)
    delta = F.col(value) - F.lag(value).over(window)
    limit = F.lit(band).cast("decimal(18,6)")
    return df.withColumn("delta", delta).withColumn("trend", F.when(F.abs("delta") <= limit, "same").when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down"))


def best_and_runner_up(df: DataFrame, by: Sequence[str], candidate: str, score: str) -> DataFrame:
    """The best candidate of each group, the best other one, and the margin; ties go to the lower candidate."""
    per = df.groupBy(*by, candidate).agg(F.max(score).alias(score))
    window = Window.partitionBy(*by).orderBy(F.desc(score), candidate)
    ranked = per.select(*by, candidate, score, F.row_number().over(window).alias("n"), F.lead(candidate).over(window).alias("runner_up"), F.lead(score).over(window).alias("runner_up_score"))
    return ranked.where("n = 1").drop("n").withColumn("margin", F.col(score) - F.coalesce("runner_up_score", F.lit(0)))


def key_changes(df: DataFrame, by: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Flag rows where the key differs from the row before: there a header is due."""
    previous = F.lag(key).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("header", ~previous.eqNullSafe(F.col(key)) | (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1))


def last_rows(df: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    return first_of(df, by, [F.desc(order)], n)


def first_and_count(df: DataFrame, identity: Sequence[str], key: str, repeats: str) -> DataFrame:
    """The least key of each identity and the number of its repeats, added up before the shuffle."""
    return df.groupBy(*identity).agg(F.min(key).alias(key), (F.count("*") - 1).alias(repeats))


def first_and_repeats(df: DataFrame, identity: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """The first row of each identity with the keys of its repeats in order."""
    row = F.struct(*order, F.col(key).alias("__key"))
    grouped = df.groupBy(*identity).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    keys = F.transform("__rows", lambda r: r["__key"])
    return grouped.select(*identity, F.element_at(keys, 1).alias(key), F.slice(keys, F.lit(2), F.size(keys)).alias("repeats"))
