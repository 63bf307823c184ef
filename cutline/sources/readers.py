"""Readers. Every schema is declared, or all text; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cutline.operators.ingest import read_cells
from cutline.operators.retrieval import title

GLYPHS = "page int, text string, x0 double, x1 double, top double, upright boolean, mx double"
GRID = (
    "run_id string, exam_year int, pages_processed array<int>, warnings array<string>, "
    "columns array<struct<column_key:string,page_number:int,raw_label:string,code:string,markers:array<string>,repeat_keys:array<string>,values:map<string,string>>>"
)
OVERRIDES = "columns array<struct<course_code:string,column_key:string,stream_codes:array<string>,raw_label:string,values:map<string,string>>>"
UNMAPPED = "columns array<struct<column_key:string,raw_label:string,course_name:string,university:string,values:map<string,string>>>"


def table(spark: SparkSession, path: str, schema: StructType | str | None = None, view: str | None = None) -> DataFrame:
    """A Parquet table, and a temporary view of it if a name is given."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def wide_csv(spark: SparkSession, path: str, period: int) -> DataFrame:
    """Cells of a CSV whose header is data: period, row, label, raw. The byte order mark and an empty first header are dealt with."""
    wide = spark.read.option("header", True).option("inferSchema", False).csv(path)
    first = wide.columns[0]
    return read_cells(wide.withColumnRenamed(first, "row"), "row", period)


def keyed_csv(spark: SparkSession, path: str, schema: StructType | str, key: str, keep: str = "last") -> DataFrame:
    """A CSV with one row kept for each key, the first or the last in the file."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    place = rows.withColumn("__at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    order = F.col("__at").asc() if keep == "first" else F.col("__at").desc()
    return place.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__at", "__n")


def json_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of a declared schema, one row for each of its columns."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.explode("columns").alias("column")).drop("columns")


def artifact_cells(columns: DataFrame) -> DataFrame:
    """Columns of an artifact as long rows: column_key, row, raw."""
    return columns.select("column.column_key", F.explode("column.values").alias("row", "raw"))


def marked_up(spark: SparkSession, path: str) -> DataFrame:
    """Text files: key from the file's stem, title from the first H1 or else the stem, content."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.[^.]*$", "").alias("key"))
    return files.select("key", title(F.col("content"), F.col("key")).alias("title"), "content")


def rotated(glyphs: DataFrame) -> DataFrame:
    return glyphs.where(~F.col("upright"))


def grid_pages(glyphs: DataFrame, names: list[str], value: str = r"-?\d\.\d{4}|NQC", least_glyphs: int = 500, least_names: int = 10, least_values: int = 50) -> DataFrame:
    """Pages that look like a rotated grid: many rotated glyphs, and enough names and values read forward or backward."""
    order = F.array_sort(F.collect_list(F.struct("x0", (-F.col("top")).alias("down"), "text")))
    pages = rotated(glyphs).groupBy("page").agg(F.count("*").alias("n"), F.array_join(F.transform(order, lambda g: g["text"]), "").alias("forward"))

    def good(text: Column) -> Column:
        named = sum((text.contains(n).cast("int") for n in names[1:]), text.contains(names[0]).cast("int"))
        return (named >= least_names) & (F.size(F.regexp_extract_all(text, F.lit(value), F.lit(0))) >= least_values)

    return pages.where((F.col("n") >= least_glyphs) & (good(F.col("forward")) | good(F.reverse("forward")))).select("page")
