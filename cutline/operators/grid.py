"""Grids from positioned glyphs: rows from rotated glyphs, columns from the usual row, values by nearest centre."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows
from .joins import greedy_nearest

VALUE = r"-?\d\.\d{4}|NQC"


def text_rows(glyphs: DataFrame, gap: float = 1.0) -> DataFrame:
    """Rotated glyphs in runs of x no further apart than ``gap``: page, line, x, tokens (text and place) and the line's text."""
    lines = windows.islands(glyphs.where("NOT upright"), ["page"], "x0", gap, "line")
    order = F.array_sort(F.collect_list(F.struct((-F.col("top")).alias("down"), "text")))
    return lines.groupBy("page", "line").agg(F.avg("x0").alias("x"), order.alias("glyphs")).withColumn("text", F.array_join(F.transform("glyphs", lambda g: g["text"]), ""))


def cells(glyphs: DataFrame, gap: float = 25.0, value: str = VALUE) -> DataFrame:
    """Tokens of each line that parse as values: page, line, at, value; glyphs of a line further apart than ``gap`` part tokens."""
    lines = windows.islands(glyphs.where("NOT upright"), ["page"], "x0", 1.0, "line").withColumn("down", -F.col("top"))
    tokens = windows.islands(lines, ["page", "line"], "down", gap, "token")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("down", "text"))), lambda g: g["text"]), "")
    joined = tokens.groupBy("page", "line", "token").agg(F.avg("down").alias("at"), F.avg("x0").alias("x"), text.alias("value"))
    return joined.where(F.col("value").rlike(f"^(?:{value})$"))


def split_grids(rows: DataFrame, at: str = "x", gap: float = 50.0) -> DataFrame:
    """Rows of a page in several grids where the distance between rows is over ``gap``."""
    return windows.islands(rows, ["page"], at, gap, "grid")


def template(found: DataFrame, least_rows: int = 10) -> DataFrame:
    """Column centres of each grid: the median place of each column over the rows of the usual width (ties: the wider)."""
    by_grid = Window.partitionBy("page", "grid", "line").orderBy("at")
    placed = found.withColumn("nth", F.row_number().over(by_grid))
    widths = placed.groupBy("page", "grid", "line").agg(F.max("nth").alias("width"))
    counts = widths.groupBy("page", "grid", "width").agg(F.count("*").alias("n"))
    usual = windows.first_of(counts, ["page", "grid"], [F.desc("n"), F.desc("width")]).select("page", "grid", "width")
    rows = widths.groupBy("page", "grid").agg(F.count("*").alias("rows")).where(F.col("rows") >= least_rows).select("page", "grid")
    typical = placed.join(widths, ["page", "grid", "line"]).join(usual, ["page", "grid", "width"]).join(rows, ["page", "grid"])
    return typical.groupBy("page", "grid", "nth").agg(F.median("at").alias("centre"))


def assign(found: DataFrame, centres: DataFrame, share: float = 0.45, single: float = 25.0) -> DataFrame:
    """Each value of a row to its own nearest column within a share of the columns' pitch: page, grid, line, at, value, nth."""
    pitch = centres.groupBy("page", "grid").agg(((F.max("centre") - F.min("centre")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("p"))
    tolerance = pitch.select("page", "grid", (F.lit(share) * F.when(F.col("p") > 0, F.col("p")).otherwise(single)).alias("tolerance"))
    wanted = found.join(tolerance, ["page", "grid"]).withColumn("key", F.concat_ws("/", "page", "grid", "line")).withColumn("scaled", F.col("at") / F.col("tolerance"))
    lines = wanted.select("page", "grid", "line", "key", "tolerance").distinct()
    targets = centres.join(lines, ["page", "grid"]).select("key", "nth", (F.col("centre") / F.col("tolerance")).alias("spot"))
    items = wanted.select("key", F.col("at").alias("item"), "scaled")
    pairs = greedy_nearest(items, targets, "key", "item", "scaled", "nth", "spot", 1.0)
    pairs = pairs.select(F.col("key").alias("pair_key"), "item", "nth")
    return wanted.join(pairs, (F.col("key") == F.col("pair_key")) & (F.col("at") == F.col("item"))).select("page", "grid", "line", "at", "value", "nth")


#: The gap that parts the segments of a line, the one that parts labels, what an overshoot costs, and the codes of a header.
SEGMENT_GAP, LABEL_GAP, OVERSHOOT, LEAST_CODES = 25.0, 8.0, 10.0, 15
#: Words that begin the titles of a table's columns, and the shortest label.
TITLES, LEAST_LABEL = ("DISTRICT", "COURSE"), 5
CODE = r"(?<![0-9])[0-9]{3}[A-Z](?![A-Za-z])"


def upright_lines(glyphs: DataFrame, gap: float = SEGMENT_GAP) -> DataFrame:
    """Segments of upright lines: page, y, x0, x1, text. Glyphs of one rounded height further apart than ``gap`` part segments; the text is mirrored back."""
    upright = glyphs.where("upright").withColumn("y", F.bround("top").cast("double"))
    before = Window.partitionBy("page", "y").orderBy("x0", "x1", "text")
    fresh = F.coalesce(F.col("x0") - F.lag("x1").over(before) > gap, F.lit(True)).cast("int")
    cut = upright.withColumn("fresh", fresh).withColumn("segment", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct("x0", "x1", "text")
    lines = cut.groupBy("page", "y", "segment").agg(F.min("x0").alias("x0"), F.max_by("x1", row).alias("x1"), F.array_sort(F.collect_list(row)).alias("row"))
    text = F.reverse(F.trim(F.array_join(F.transform("row", lambda g: g["text"]), "")))
    return lines.select("page", "y", "x0", "x1", text.alias("text")).where("text <> ''")


def bands(rows: DataFrame, at: str = "x") -> DataFrame:
    """Where the rows of each grid lie: page, grid, low, high."""
    return rows.groupBy("page", "grid").agg(F.min(at).alias("low"), F.max(at).alias("high"))


def label_band(edge: Column, low: Column) -> Column:
    """What it costs to give a label that ends at ``edge`` to a band that begins at ``low``: the gap, or ten times what it overshoots."""
    return F.when(low >= edge, low - edge).otherwise((edge - low) * OVERSHOOT)


def nearest_band(items: DataFrame, of_bands: DataFrame, cost: Callable[[Column, Column], Column]) -> DataFrame:
    """The items, each with the grid of its page whose band (low, high) costs least (ties: the first). A page has a few bands, in one array beside its items."""
    held = of_bands.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("grid", "low", "high"))).alias("bands"))
    best = F.array_min(F.transform("bands", lambda b: F.struct(cost(b["low"], b["high"]).alias("cost"), b["grid"].alias("grid"))))
    return items.join(held, "page").withColumn("grid", best["grid"]).drop("bands")


def label_blocks(lines: DataFrame, of_bands: DataFrame, gap: float = LABEL_GAP) -> DataFrame:
    """Labels of each grid: page, grid, at, label. Lines go to the band of least cost; lines that follow within ``gap`` are one
    label, read from the last line up. Short ones and titles are left out."""
    placed = nearest_band(lines, of_bands, lambda low, _: label_band(F.col("x1"), low))
    blocks = windows.islands(placed, ["page", "grid"], "y", gap, "block")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x0", "text")), False), lambda r: r["text"]), " ")
    labels = blocks.groupBy("page", "grid", "block").agg(F.avg("y").alias("at"), text.alias("label"))
    title = F.lit(False)
    for t in TITLES:
        title = title | F.upper("label").startswith(t)
    return labels.where((F.length("label") >= LEAST_LABEL) & ~title).select("page", "grid", "at", "label")


def code_header(glyphs: DataFrame, of_bands: DataFrame, code: str = CODE, least: int = LEAST_CODES) -> DataFrame:
    """Codes of each grid's header, the cluster of rotated glyphs with the most codes (ties: the first): page, grid, nth, at, code.

    A cluster goes to the band that its mean place is nearest to; its text is read from the last glyph up, and it is a
    header if it holds ``least`` different codes. A code stands at the mean height of its glyphs.
    """
    lines = windows.islands(glyphs.where("NOT upright"), ["page"], "x0", 1.0, "cluster")
    text = F.sort_array(F.collect_list(F.struct("top", "x0", "text")), False)
    clusters = lines.groupBy("page", "cluster").agg(F.avg("x0").alias("x"), text.alias("up"))
    outside = lambda low, high: F.greatest(low - F.col("x"), F.col("x") - high, F.lit(0.0))
    placed = nearest_band(clusters, of_bands, outside).withColumn("said", F.array_join(F.transform("up", lambda g: g["text"]), ""))
    # where codes begin: the lengths of what stands between them and of themselves, added up
    parts, found = F.split("said", code, -1), F.regexp_extract_all("said", F.lit(code), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,code:string>>").alias("codes"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["part"])
        return F.struct((begin + F.length(pair["code"])).alias("at"), F.concat(state["codes"], F.array(F.struct(begin.alias("start"), pair["code"].alias("code")))).alias("codes"))

    zipped = F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("part"), found.alias("code"))
    codes = F.aggregate(zipped, start, step)["codes"]
    heads = placed.withColumn("codes", codes).where(F.size(F.array_distinct(F.transform("codes", lambda c: c["code"]))) >= least)
    best = windows.first_of(heads.withColumn("n", F.size("codes")), ["page", "grid"], [F.desc("n"), F.col("cluster")])
    tops = lambda c: F.transform(F.slice("up", c["start"] + 1, F.length(c["code"])), lambda g: g["top"])
    mean = lambda c: F.aggregate(tops(c), F.lit(0.0), lambda a, b: a + b) / F.length(c["code"])
    each = best.select("page", "grid", F.explode(F.transform("codes", lambda c: F.struct(mean(c).alias("at"), c["code"].alias("code")))).alias("c"))
    nth = F.row_number().over(Window.partitionBy("page", "grid").orderBy("c.at", "c.code"))
    return each.select("page", "grid", nth.alias("nth"), "c.at", "c.code")


def consolidate(columns: DataFrame, label: str = "label", values: str = "values", key: str = "column_key") -> tuple[DataFrame, DataFrame]:
    """Columns that repeat in label and all values become one, with the repeats' keys; labels with different values are conflicts."""
    identity = columns.withColumn("__v", F.sha2(F.to_json(F.array_sort(F.map_entries(values))), 256))
    kept = windows.first_and_repeats(identity, [label, "__v"], [key], key)
    conflicts = kept.groupBy(label).agg(F.count("*").alias("variants")).where("variants > 1")
    return kept.drop("__v"), conflicts


def section_rows(fragments: DataFrame, bounds: tuple[float, float], reach: float = 3.0, most: float = 12.0) -> DataFrame:
    """Rows of a three-column section: fragments (page, x0, top, text) are cut into columns at two x bounds, anchored by
    the codes of the last column, and each goes to its page's nearest row within ``most``: page, row, name, place, code."""

    def build(page: pd.DataFrame) -> pd.DataFrame:
        tops: list[float] = []
        for top in sorted(page.loc[page.x0 >= bounds[1], "top"]):
            if not tops or top - tops[-1] > reach:
                tops.append(top)
        parts = {i: {"name": [], "place": [], "code": []} for i in range(len(tops))}
        for f in page.sort_values(["top", "x0"]).itertuples():
            if not tops:
                break
            near = min(range(len(tops)), key=lambda i: (abs(tops[i] - f.top), i))
            if abs(tops[near] - f.top) <= most:
                parts[near]["name" if f.x0 < bounds[0] else "place" if f.x0 < bounds[1] else "code"].append(f.text)
        rows = [(int(page.page.iloc[0]), i, " ".join(p["name"]), " ".join(p["place"]), " ".join(p["code"])) for i, p in parts.items()]
        return pd.DataFrame(rows, columns=["page", "row", "name", "place", "code"])

    return fragments.groupBy("page").applyInPandas(build, "page int, row int, name string, place string, code string")
