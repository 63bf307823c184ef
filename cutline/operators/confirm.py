"""What confirming the mapping of a run produces, and writing all of it as one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.functions import columns as C
from cutline.sources import manifest

from . import presence, windows


class Blocked(Exception):
    """The run can't be confirmed; the text says why and names the first few columns."""


def _few(df: DataFrame, column: str) -> str:
    return ", ".join(r[0] for r in df.orderBy(column).limit(5).select(column).collect())  # five names for a message


def gate(columns: DataFrame, grid: DataFrame) -> None:
    """Raise ``Blocked`` unless no column is pending, one at least is of use, streams of one code don't clash and all values are there.

    columns: column_key, page, raw_label, code, status, streams; grid: column_key, values.
    """
    pending = columns.where("status = 'pending'")
    if not pending.isEmpty():
        raise Blocked(f"columns still pending: {_few(pending, 'column_key')}")
    useful = columns.where("status = 'confirmed' AND code IS NOT NULL OR status = 'unmapped_kept'")
    if useful.isEmpty():
        raise Blocked("no confirmed or kept column")
    used = columns.where("status = 'confirmed' AND code IS NOT NULL")
    plain = used.groupBy("code").agg(F.count_if(F.coalesce(F.size("streams"), F.lit(0)) == 0).alias("n")).where("n > 1").select("code")
    shared = used.select("code", F.explode(F.array_distinct("streams")).alias("stream")).groupBy("code", "stream").count().where("count > 1").select("code")
    clashing = plain.unionByName(shared).distinct()
    if not clashing.isEmpty():
        raise Blocked(f"several columns for one code: {_few(clashing, 'code')}")
    lost = useful.join(grid.select("column_key"), "column_key", "left_anti")
    if not lost.isEmpty():
        raise Blocked(f"columns without values: {_few(lost, 'column_key')}")


def outputs(columns: DataFrame, grid: DataFrame, aliases: DataFrame, catalog: DataFrame, before: DataFrame, source: str, present: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that a confirmed run leaves: aliases, cells, overrides, unmapped, changes.

    aliases: alias_text, course_code, source, confidence, the state with the labels that are new; catalog: code and
    is_active; before: code, row, value of the period before; present: codes that are printed anywhere in the book.
    cells: code, nth, row, value, the columns of the wide table in order; a code that has streams only gets cells
    without a value. overrides and unmapped hold the values of streams and of columns without a code by themselves.
    """
    used = columns.where("status = 'confirmed' AND code IS NOT NULL").withColumn("streams", F.coalesce("streams", F.array().cast("array<string>")))
    label = F.trim(F.coalesce("raw_label", F.lit("")))
    learned = used.select(label.alias("alias_text"), F.col("code").alias("course_code")).where("alias_text <> '' AND alias_text <> course_code").distinct()
    fresh = learned.join(aliases.select("alias_text", "course_code"), ["alias_text", "course_code"], "left_anti")
    whole = aliases.unionByName(fresh.select("alias_text", "course_code", F.lit(source).alias("source"), F.lit(1.0).alias("confidence")))
    first = used.groupBy("code").agg(F.min(F.struct("page", "column_key")).alias("first"))
    order = first.select("code", F.row_number().over(Window.orderBy("first")).alias("nth"))  # a row for each code of one book
    rows = grid.select(F.explode(F.map_keys("values")).alias("row")).distinct()
    values = grid.select("column_key", F.explode_outer("values").alias("row", "value"))
    plain = windows.first_of(used.where(F.size("streams") == 0), ["code"], [F.col("column_key")]).select("code", "column_key").join(values, "column_key").select("code", "row", "value")
    cells = order.join(rows, how="cross").join(plain, ["code", "row"], "left").select("code", "nth", "row", "value")  # the cells of one book's table
    overrides = used.where(F.size("streams") > 0).join(grid, "column_key").select(F.col("code").alias("course_code"), "column_key", F.array_sort("streams").alias("stream_codes"), "raw_label", "values")
    split = C.last_parenthetical(F.coalesce("raw_label", F.lit("")))
    kept = columns.where("status = 'unmapped_kept'").join(grid, "column_key")
    unmapped = kept.select("column_key", "raw_label", F.nullif(split["base"], F.lit("")).alias("course_name"), F.nullif(split["inner"], F.lit("")).alias("university"), "values")
    number = F.col("value").try_cast("double")
    now = cells.where("value IS NOT NULL").select("code", "row", number.alias("value"))
    # a code with streams only is in the book, without a number
    now = now.unionByName(order.join(now.select("code"), "code", "left_anti").select("code", F.lit(None).cast("string").alias("row"), F.lit(None).cast("double").alias("value")))
    changes = presence.diff_with_book(before, now, catalog, "code", "row", "value", present)
    return {"aliases": whole, "cells": cells, "overrides": overrides, "unmapped": unmapped, "changes": changes}


def confirm(root: str, columns: DataFrame, grid: DataFrame, aliases: DataFrame, catalog: DataFrame, before: DataFrame, source: str, present: DataFrame | None = None) -> int:
    """Check the run and write its tables as one commit; the version. Overrides and unmapped columns of an earlier try go if there are none now."""
    gate(columns, grid)
    made = outputs(columns, grid, aliases, catalog, before, source, present)
    tables: dict[str, DataFrame | None] = {k: df for k, df in made.items()}
    for name in ("overrides", "unmapped"):
        if made[name].isEmpty():
            tables[name] = None
    return manifest.commit(columns.sparkSession, root, tables)
