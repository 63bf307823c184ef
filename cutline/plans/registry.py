"""Where queries over the driver's tables are registered with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for those who read the result without decimals of their own."""
    return df.withColumns({c: df[c].cast("double") for c, kind in df.dtypes if kind.startswith("decimal")})


def query(sql: str | None = None):
    """Register a function of Tables under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(Tables(spark, sf_dir)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
