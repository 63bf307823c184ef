"""Joins beyond the plain ones. None hints a broadcast: Spark picks it from the sizes it knows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.sources.places import stash


def override_join(base: DataFrame, overrides: DataFrame, on: Sequence[str], value: str, override: str, out: str, only: Column | None = None) -> DataFrame:
    """Left join on the keys, with ``only`` a condition on the overrides; ``out`` is the override or else the base value."""
    held = overrides if only is None else overrides.where(only)
    held = held.select(*on, F.col(override).alias("__override"))
    return base.join(held, list(on), "left").withColumn(out, F.coalesce("__override", value)).drop("__override")


def exists_flag(left: DataFrame, right: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """EXISTS as a boolean column."""
    keys = right.select(*on).distinct().withColumn("__held", F.lit(True))
    return left.join(keys, list(on), "left").withColumn(flag, F.coalesce("__held", F.lit(False))).drop("__held")


def count_of(left: DataFrame, right: DataFrame, on: Sequence[str], name: str, where: Column | None = None) -> DataFrame:
    """A correlated COUNT: aggregate first, then join."""
    counted = (right if where is None else right.where(where)).groupBy(*on).agg(F.count("*").alias(name))
    return left.join(counted, list(on), "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def top_one(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """A correlated LIMIT 1."""
    window = Window.partitionBy(*on).orderBy(*order)
    first = right.withColumn("__n", F.row_number().over(window)).where("__n = 1").select(*on, *columns)
    return left.join(first, list(on), "left")


def nested_array(left: DataFrame, right: DataFrame, on: Sequence[str], element: str, name: str) -> DataFrame:
    """ARRAY(subquery): sorted values per row, empty where there are none."""
    grouped = right.groupBy(*on).agg(F.sort_array(F.collect_list(element)).alias(name))
    kind = grouped.schema[name].dataType.simpleString()
    return left.join(grouped, list(on), "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def max_of(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, name: str) -> DataFrame:
    """The largest value of the right for each row of the left, or null: MAX in a correlated subquery."""
    return left.join(right.groupBy(*on).agg(F.max(value).alias(name)), list(on), "left")


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """NOT IN with its treatment of nulls: a null on the right leaves nothing, a null on the left is never kept."""
    held = right.select(F.col(other).alias("__held"))
    facts = held.agg((F.count("*") > 0).alias("__some"), F.coalesce(F.bool_or(F.col("__held").isNull()), F.lit(False)).alias("__null"))
    open_ = left.join(F.broadcast(facts)).where(~F.col("__null") & (F.col(column).isNotNull() | ~F.col("__some")))  # one row of facts
    return open_.drop("__some", "__null").join(held.where("__held IS NOT NULL"), F.col(column) == F.col("__held"), "left_anti")


def missing_or_different(left: DataFrame, right: DataFrame, on: Sequence[str], mine: str, theirs: str) -> DataFrame:
    """Rows of the left that the right lacks or holds with another value; two nulls don't differ."""
    held = right.select(*on, F.col(theirs).alias("__theirs"), F.lit(True).alias("__held"))
    joined = left.join(held, list(on), "left")
    return joined.where(F.col("__held").isNull() | (F.col(mine) != F.col("__theirs"))).drop("__theirs", "__held")


def full_compare(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Both sides of a key, with side 'left', 'right' or 'both': keys, left_value, right_value, side."""
    a = left.select(*on, F.col(value).alias("left_value"), F.lit(True).alias("__a"))
    b = right.select(*on, F.col(value).alias("right_value"), F.lit(True).alias("__b"))
    side = F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right").otherwise("both")
    return a.join(b, list(on), "full").select(*on, "left_value", "right_value", side.alias("side"))


def nearest_row(items: DataFrame, targets: DataFrame, on: Sequence[str], item_at: str, target_at: str, target_key: str, most: float | None = None) -> DataFrame:
    """Many to one: each item gets the nearest target of its group (ties: the lower key) within ``most``.

    Both sides are merged in order, so no pairs are made: the nearest target is the last before or the first after.
    """
    t = targets.select(*on, F.col(target_at).alias("__at"), F.struct(F.col(target_at).alias("at"), F.col(target_key).alias("key")).alias("__t"))
    i = items.withColumn("__at", F.col(item_at)).withColumn("__row", F.struct(*items.columns))
    both = i.select(*on, "__at", "__row").unionByName(t, allowMissingColumns=True)
    before = F.last("__t", ignorenulls=True).over(Window.partitionBy(*on).orderBy("__at", F.col("__t").isNull(), F.desc("__t.key")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__t", ignorenulls=True).over(Window.partitionBy(*on).orderBy("__at", F.col("__t").isNotNull(), F.asc("__t.key")).rowsBetween(0, Window.unboundedFollowing))
    placed = both.select("__row", "__at", before.alias("b"), after.alias("a")).where("__row IS NOT NULL")
    db, da = F.abs(F.col("__at") - F.col("b.at")), F.abs(F.col("__at") - F.col("a.at"))
    first = F.col("a").isNull() | (db < da) | ((db == da) & (F.col("b.key") <= F.col("a.key")))
    distance = F.when(first, db).otherwise(da)
    key = F.when(first, F.col("b.key")).otherwise(F.col("a.key"))
    near = F.lit(True) if most is None else distance <= most
    return placed.select("__row.*", F.when(near, key).alias("nearest"), F.when(near, distance).alias("distance"))


def greedy_nearest(items: DataFrame, targets: DataFrame, group: str, item: str, item_at: str, target: str, target_at: str, tolerance: float) -> DataFrame:
    """One to one: items in order each take the nearest free target within the tolerance; ties go to the later target.

    Each group (a grid) is small by nature and one task's work; its rows come as two small frames.
    """

    def assign(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free = list(b.sort_values([target_at, target]).itertuples(index=False))
        out = []
        for row in a.sort_values([item_at, item]).to_dict("records"):
            best = None
            for t in free:
                d = abs(getattr(t, target_at) - row[item_at])
                if d <= tolerance and (best is None or d <= best[0]):
                    best = (d, t)
            if best:
                free.remove(best[1])
            out.append((row[group], row[item], getattr(best[1], target) if best else None))
        return pd.DataFrame(out, columns=[group, item, target]).astype({target: "object"})

    schema = f"{group} {items.schema[group].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, {target} {targets.schema[target].dataType.simpleString()}"
    mine = items.toDF(*items.columns)  # fresh columns: both sides may come from one table
    return mine.groupBy(F.col(group)).cogroup(targets.toDF(*targets.columns).groupBy(F.col(group))).applyInPandas(assign, schema)


def subset_of_any(left: DataFrame, words: str, right: DataFrame, other_words: str, key: str) -> DataFrame:
    """Rows of the left with a flag: some row of the right (of the same key) holds all their words."""
    pairs = left.select(key, words).distinct().join(right.select(key, other_words), key)
    held = pairs.where(F.size(F.array_except(words, other_words)) == 0).select(key, words).distinct().withColumn("subset", F.lit(True))
    return left.join(held, [key, words], "left").withColumn("subset", F.coalesce("subset", F.lit(False)))


def words_held(items: DataFrame, key: str, words: str, texts: DataFrame, text_words: str) -> DataFrame:
    """The items with a flag ``subset``: some text holds all their (distinct) words. Items without words fit any text.

    Each text is cut into words once; those that any item has are stored, a row each. An item meets only the texts that
    hold its rarest word (ties: the word that sorts first), and there its words are counted: no array is made or compared.
    """
    each = items.select(key, F.size(F.array_distinct(words)).alias("__m"), F.explode(F.array_distinct(words)).alias("__x"))
    known = each.select("__x").distinct()
    cut = texts.select(F.monotonically_increasing_id().alias("__id"), F.array_distinct(text_words).alias("__w")).select("__id", F.explode("__w").alias("__x"))
    held = stash(cut.join(known, "__x", "left_semi").select("__id", "__x"), "held_words")
    said = held.groupBy("__x").agg(F.count("*").alias("__n"))
    rarest = each.join(said, "__x", "left").groupBy(key).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__x").alias("x"))).alias("__r")).where("__r.n > 0")
    # files of words are small for their rows: by their size Spark would broadcast them
    met = held.hint("merge").join(rarest.select(key, F.col("__r.x").alias("__x")), "__x").select(key, "__id")
    counted = met.join(each, key).join(held.hint("merge"), ["__id", "__x"]).groupBy(key, "__id", "__m").agg(F.count("*").alias("__k"))
    found = counted.where("__k = __m").select(key).distinct()
    none = items.where(F.size(words) == 0).select(key).join(texts.limit(1).select(F.lit(True).alias("__any")), how="cross").select(key)  # one text at most
    return exists_flag(items, found.unionByName(none), [key], "subset")
