"""Every registered query against its SQL on the smallest tables."""

import pytest

from cutline.plans.catalog import ORACLES, QUERIES

from .compare import DATA, rows, same

pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(f"{DATA}/sf0.001"), reason="no tables")


def _all(df):
    return df.columns, df.collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_alike(spark, name):
    """Queries without SQL, held against plain versions elsewhere: some rows, the same on each run and however they are dealt out."""
    first = rows(*_all(QUERIES[name](spark, f"{DATA}/sf0.001")))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = rows(*_all(QUERIES[name](spark, f"{DATA}/sf0.001")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first and first == again


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
