"""Wide and long, sets, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_matrix(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], cell: str) -> DataFrame:
    """Long to wide over a known list of columns, so that one pass is enough."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.first(cell, ignorenulls=True))


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], label: str, cell: str, keep_null: bool = True) -> DataFrame:
    long = df.unpivot(list(ids), list(values), label, cell)
    return long if keep_null else long.where(F.col(cell).isNotNull())


def cells_by_stream(df: DataFrame, keys: Sequence[str], cells: str, streams: str) -> DataFrame:
    """A map of cells and an array of streams to one row for each cell and stream."""
    long = df.select(*keys, F.explode(cells).alias("row", "cell"), F.col(streams).alias("__s"))
    return long.select(*keys, "row", "cell", F.explode("__s").alias("stream"))


def zip_headers(df: DataFrame, keys: Sequence[str], headers: str, values: str) -> DataFrame:
    pairs = F.arrays_zip(F.col(headers).alias("h"), F.col(values).alias("v"))
    return df.select(*keys, F.posexplode(pairs).alias("pos", "p")).select(*keys, "pos", F.col("p.h").alias("header"), F.col("p.v").alias("value"))


def history_map(df: DataFrame, by: Sequence[str], key: str, value: str, out: str) -> DataFrame:
    """Rows of a group as one map, in order of the key."""
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(out))


def page(df: DataFrame, order: Sequence[Column], size: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page, and the count of all rows as a table of one row; both read the same filtered input."""
    return df.orderBy(*order).offset(offset).limit(size), df.agg(F.count("*").alias("total"))


def padded_union(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; what a table lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
