"""Writers. Keyed tables are written as the new state of what they touch; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cutline.operators.ingest import upsert
from cutline.operators.reshape import to_matrix


def wide_matrix(cells: DataFrame, row: str, column: str, value: str, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A wide table with the rows of an order table (row, nth) and the given columns; what is missing is an empty text."""
    wide = to_matrix(cells.withColumn(value, F.col(value).cast("string")), [row], column, columns, value)
    out = rows.join(wide, row, "left").orderBy("nth")
    return out.select(row, *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def relabelled(cells: DataFrame, names: DataFrame, code: str, name: str) -> DataFrame:
    """Codes with their names beside them, unknown codes marked."""
    label = F.concat_ws(" | ", F.col(code), F.coalesce(name, F.lit("(NOT IN SEED)")))
    return cells.join(names.select(code, name), code, "left").withColumn("header", label).drop(name)


def write_upsert(new: DataFrame, path: str, keys: Sequence[str], partition: str) -> None:
    """Upsert into a table partitioned by one of the keys; only the partitions of the new rows are written again."""
    spark = new.sparkSession
    touched = new.select(partition).distinct()
    try:
        old = spark.read.parquet(path).join(touched, partition, "left_semi").select(*new.columns)
    except Exception as e:  # the first load has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = new.limit(0)
    state = upsert(old, new, keys)
    staged = f"{path.rstrip('/')}__staged"
    state.write.mode("overwrite").partitionBy(partition).parquet(staged)
    spark.read.schema(new.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def snapshot(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Write each table that has rows before it is overwritten; returns the names written."""
    done = []
    for name, df in tables.items():
        if not df.isEmpty():
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
            done.append(name)
    return done


def put_artifact(df: DataFrame, store: str, run_id: str, kind: str) -> str:
    """A keyed store: one folder for each run and kind, which takes the place of what was there."""
    path = f"{store}/{run_id}/{kind}"
    df.write.mode("overwrite").json(path)
    return path


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def artifact_exists(spark: SparkSession, store: str, run_id: str, kind: str) -> bool:
    place, fs = _place(spark, f"{store}/{run_id}/{kind}")
    return fs.exists(place)


def load_artifact(spark: SparkSession, store: str, run_id: str, kind: str, schema: StructType | str) -> DataFrame | None:
    """What was put there, or None."""
    return spark.read.schema(schema).json(f"{store}/{run_id}/{kind}") if artifact_exists(spark, store, run_id, kind) else None


def delete_artifact(spark: SparkSession, store: str, run_id: str, kind: str) -> bool:
    """Whether there was one to delete."""
    place, fs = _place(spark, f"{store}/{run_id}/{kind}")
    return fs.delete(place, True)


def archive_run(spark: SparkSession, store: str, run_id: str, archive: str, period: int, tag: str, kinds: Sequence[str]) -> list[str]:
    """Copy a run's artifacts to ``archive/<period>/<kind>_<period>_<tag>``; those it lacks are passed over. The paths written, below ``archive``."""
    written = []
    for kind in kinds:
        source, fs = _place(spark, f"{store}/{run_id}/{kind}")
        if fs.exists(source):
            name = f"{period}/{kind}_{period}_{tag}"
            target, other = _place(spark, f"{archive}/{name}")
            other.mkdirs(target.getParent())
            if other.exists(target):
                other.delete(target, True)
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, other, target, False, spark._jsc.hadoopConfiguration())
            written.append(name)
    return written


def request_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def append_audit(requests: DataFrame, path: str, parts: Sequence[str]) -> bool:
    """Append hash and payload of each request; a failure is told by the result and never breaks the query."""
    rows = requests.select(request_hash(*(F.col(p) for p in parts)).alias("request_hash"), F.to_json(F.struct(*requests.columns)).alias("payload"))
    try:
        rows.write.mode("append").parquet(path)
    except Exception:  # the audit is best effort
        return False
    return True
