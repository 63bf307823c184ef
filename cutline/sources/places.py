"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only in local mode a temporary folder may stand in."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cutline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and lost executors cost nothing.

    The folder goes with ``drop``, with ``drop_all``, or when Python ends.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    _PATHS[held], _LEFT[path] = path, spark
    return held


def register(spark: SparkSession, path: str) -> str:
    """Have a path that an operator fills itself deleted as stashed tables are."""
    _LEFT[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(*held: DataFrame) -> None:
    """Delete stashed tables that no later step reads."""
    for df in held:
        path = _PATHS.pop(df)
        _delete(_LEFT.pop(path), path)


def drop_all(spark: SparkSession) -> None:
    """Delete all that this session has stashed: results that read from there are void then."""
    for path in [p for p, s in _LEFT.items() if s is spark]:
        _delete(spark, path)
        del _LEFT[path]


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end whatever has been stashed inside: for long-lived drivers. Results are to be written or counted before it ends."""
    before = set(_LEFT)
    try:
        yield
    finally:
        for path in [p for p, s in _LEFT.items() if s is spark and p not in before]:
            _delete(spark, path)
            del _LEFT[path]


@atexit.register
def _at_the_end() -> None:
    for path, spark in list(_LEFT.items()):
        with contextlib.suppress(Exception):  # the session may be gone already
            _delete(spark, path)
