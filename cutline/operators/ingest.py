"""Wide tables to validated long rows, and new states of keyed tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.functions import columns as C


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new state of a table: rows of ``new`` take the place of those of the same key. A key twice in ``new`` is an error."""
    ranked = new.withColumn("__p", F.lit(0)).unionByName(old.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    window = Window.partitionBy(*keys)
    marked = ranked.withColumn("__twice", F.count_if(F.col("__p") == 0).over(window)).withColumn("__n", F.row_number().over(window.orderBy("__p")))
    checked = F.when(F.col("__twice") > 1, F.raise_error(F.lit("a key occurs twice in the new rows")).cast("int")).otherwise(F.col("__n"))
    return marked.withColumn("__n", checked).where("__n = 1").drop("__p", "__n", "__twice")


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose key the table lacks, one for each key; to be appended, their number is the count inserted."""
    window = Window.partitionBy(*keys).orderBy(*([c for c in new.columns if c not in keys] or keys))
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    return fresh.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def read_cells(wide: DataFrame, row: str, period: int) -> DataFrame:
    """Cells of a wide text table: period, row, label, raw; blank rows and blank headers are passed over."""
    labels = [c for c in wide.columns if c != row and c.strip() and not re.match("_blank_|_c[0-9]+$", c)]
    long = wide.where(F.trim(F.coalesce(F.col(f"`{row}`"), F.lit(""))) != "").unpivot([F.col(f"`{row}`")], [F.col(f"`{c}`") for c in labels], "label", "raw")
    return long.select(F.lit(period).alias("period"), F.col(f"`{row}`").alias("row"), "label", "raw")


def resolve_cells(cells: DataFrame, rows: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and error rows from one plan: unknown rows and labels, and values that don't parse, are errors.

    cells: period, row, label, raw; rows: row_code, row_id; aliases: label, code.
    """
    key = F.translate(F.upper(F.regexp_replace(F.trim("row"), r"\s+", " ")), " ", "_")
    read = cells.withColumn("row_code", key).join(rows, "row_code", "left").join(aliases, "label", "left").withColumn("v", C.parse_value(F.col("raw")))
    problem = F.when(F.col("row_id").isNull(), "UNKNOWN_ROW").when(F.col("code").isNull(), "UNKNOWN_LABEL").otherwise(F.col("v.problem"))
    judged = read.withColumn("problem", problem)
    good = judged.where("problem IS NULL").select("period", "code", "row_id", F.col("v.value").alias("value"), F.when(F.upper(F.trim("raw")) == "NQC", "NQC").alias("note"))
    return good, judged.where("problem IS NOT NULL").select("period", "row", "label", "raw", "problem")


def run_status(good: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: n_good, n_errors and success, partial or failed."""
    counts = good.agg(F.count("*").alias("n_good")).crossJoin(errors.agg(F.count("*").alias("n_errors")))
    return counts.withColumn("status", F.when(F.col("n_good") == 0, "failed").when(F.col("n_errors") > 0, "partial").otherwise("success"))


def annotate(base: DataFrame, overrides: DataFrame, keys: Sequence[str], stream: str, value: str) -> DataFrame:
    """Notes of the base rows with what each stream's override says, in order of the stream."""
    text = F.concat_ws("=", F.col(stream), F.col(value).cast("string"))
    said = overrides.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(stream), text.alias("t")))).alias("__o"))
    note = F.array_join(F.transform("__o", lambda o: o["t"]), "; ")
    return base.join(said, list(keys), "left").withColumn("notes", F.when(F.col("__o").isNotNull(), note).otherwise(F.col("notes"))).drop("__o")


def apply_changes(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Each change with its outcome: deactivated, inserted, or why it was skipped. changes: key, change_type, status."""
    held = table.select(key, "is_active")
    joined = changes.join(held, key, "left")
    outcome = (
        F.when(F.col("status") != "approved", "skipped: not approved")
        .when((F.col("change_type") == "removed") & F.col("is_active").isNull(), "skipped: unknown")
        .when((F.col("change_type") == "removed") & ~F.col("is_active"), "skipped: already inactive")
        .when(F.col("change_type") == "removed", "deactivated")
        .when((F.col("change_type") == "added") & F.col("is_active").isNotNull(), "skipped: exists")
        .when(F.col("change_type") == "added", "inserted")
        .otherwise("skipped: nothing to do")
    )
    return joined.select(key, "change_type", outcome.alias("outcome"))


def bulk_confirm(suggestions: DataFrame, known: DataFrame, key: str, code: str, least: float = 0.999) -> DataFrame:
    """Pending suggestions that are sure and whose code is known become confirmed."""
    codes = known.select(F.col(code).alias("suggested"), F.lit(True).alias("__k")).distinct()
    joined = suggestions.join(codes, "suggested", "left")
    sure = (F.col("status") == "pending") & (F.col("confidence") >= least) & F.col("__k").isNotNull()
    return joined.withColumn("status", F.when(sure, "confirmed").otherwise(F.col("status"))).drop("__k")


def exclusive_activation(configs: DataFrame, key: str, chosen) -> DataFrame:
    """The table with one row active; a key that it lacks changes nothing."""
    held = configs.agg(F.coalesce(F.bool_or(F.col(key) == F.lit(chosen)), F.lit(False)).alias("__held"))  # one row
    return configs.join(F.broadcast(held)).withColumn("is_active", F.when(F.col("__held"), F.coalesce(F.col(key) == F.lit(chosen), F.lit(False))).otherwise(F.col("is_active"))).drop("__held")


def version_bump(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New contents: the version goes up only where the hash changes, also to or from null; new keys begin at 1."""
    held = old.select(key, F.col("content").alias("__c"), F.col("version").alias("__v"))
    changed = ~F.sha2("content", 256).eqNullSafe(F.sha2("__c", 256))
    version = F.when(F.col("__v").isNull(), 1).when(changed, F.col("__v") + 1).otherwise(F.col("__v"))
    return new.join(held, key, "left").withColumn("version", version).drop("__c", "__v")
