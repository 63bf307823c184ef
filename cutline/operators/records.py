"""Codes, keys and states of stored records: resolution, renames, replaced sets, confirmations, checklists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a run may go on to from each state. A run can be started again from needs_pages, needs_mapping and failed; success and partial are final.
RUN_STATES = {
    "running": ("needs_pages", "needs_mapping", "failed", "success", "partial"),
    "needs_pages": ("running", "failed"),
    "needs_mapping": ("running", "failed", "success"),
    "failed": ("running",),
}


def resolve_codes(df: DataFrame, code: str, known: DataFrame, known_code: str, known_id: str, name: str) -> DataFrame:
    """The id of each row's code as ``name``; a code that isn't known ends the query with an error that names it. Null codes have no id."""
    ids = known.select(F.col(known_code).alias("__code"), F.col(known_id).alias("__id"), F.lit(True).alias("__known"))
    joined = df.join(ids, F.col(code) == F.col("__code"), "left")
    unknown = F.col(code).isNotNull() & F.col("__known").isNull()
    kind = dict(ids.dtypes)["__id"]
    found = F.when(unknown, F.raise_error(F.concat(F.lit("unknown code: "), F.col(code).cast("string"))).cast(kind)).otherwise(F.col("__id"))
    return joined.withColumn(name, found).drop("__code", "__id", "__known")


def longest_prefix(df: DataFrame, text: str, dictionary: DataFrame, prefix: str, value: str) -> DataFrame:
    """The value of the longest dictionary entry that each text begins with, or null; of an entry's values the least.

    Each text is cut to the lengths that occur in the dictionary and these beginnings are joined by equality.
    """
    entries = dictionary.select(F.col(prefix).alias("__p"), F.col(value).alias("__v")).where("__p IS NOT NULL").groupBy("__p").agg(F.min("__v").alias("__v"))
    lengths = [r[0] for r in entries.select(F.length("__p")).distinct().collect()]  # no more than the longest entry has characters
    cuts = F.array(*(F.when(F.length(text) >= n, F.left(text, F.lit(n))) for n in sorted(lengths)))
    texts = df.select(text).distinct()
    met = texts.select(text, F.explode(F.array_compact(cuts)).alias("__p")).join(entries, "__p").groupBy(text).agg(F.max_by("__v", F.length("__p")).alias(value))
    return df.join(met, text, "left")


def by_key_or_padded(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, width: int) -> DataFrame:
    """The value of each row's key, or of the key filled up with zeros to ``width`` where the table lacks it."""
    held = table.select(F.col(table_key).alias("__k"), F.col(value).alias("__v"))
    own, padded = held.toDF("__k1", "__v1"), held.toDF("__k2", "__v2")
    joined = df.join(own, F.col(key) == F.col("__k1"), "left").join(padded, F.lpad(F.col(key), F.greatest(F.lit(width), F.length(key)), F.lit("0")) == F.col("__k2"), "left")
    return joined.withColumn(value, F.coalesce("__v1", "__v2")).drop("__k1", "__v1", "__k2", "__v2")


def replace_sets(old: DataFrame, new: DataFrame, owner: str, owners: DataFrame) -> DataFrame:
    """The new state: the rows of the given owners give way to theirs in ``new``, none included; others stay."""
    named = owners.select(owner).distinct()
    return old.join(named, owner, "left_anti").unionByName(new.join(named, owner, "left_semi"))


def delete_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new state without the rows of the given keys."""
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def identify(people: DataFrame, held: DataFrame, first: str, second: str, id_: str) -> DataFrame:
    """The stored id of each person: by the first key, or else by the second, or null for a new one."""
    a = held.where(F.col(first).isNotNull()).groupBy(F.col(first).alias("__a")).agg(F.min(id_).alias("__ia"))
    b = held.where(F.col(second).isNotNull()).groupBy(F.col(second).alias("__b")).agg(F.min(id_).alias("__ib"))
    joined = people.join(a, F.col(first) == F.col("__a"), "left").join(b, F.col(second) == F.col("__b"), "left")
    return joined.withColumn(id_, F.coalesce("__ia", "__ib")).drop("__a", "__ia", "__b", "__ib")


def merge_keys(facts: DataFrame, renames: DataFrame, key: str, old: str, new: str, rest: Sequence[str], value: str) -> DataFrame:
    """The state after codes are renamed: rows of ``old`` codes come under ``new`` ones, where a row of the new code itself comes first.

    Of several old codes' rows that meet under one key, the one of the least old code stays.
    """
    names = renames.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    moved = facts.join(names, F.col(key) == F.col("__old"), "left")
    rank = F.struct(F.col("__old").isNotNull(), F.col(key))
    moved = moved.select(F.coalesce("__new", key).alias("__key"), *rest, F.struct(rank.alias("rank"), F.col(value).alias("value")).alias("__row"))
    return moved.groupBy("__key", *rest).agg(F.min_by(F.col("__row.value"), F.col("__row.rank")).alias(value)).withColumnRenamed("__key", key)


def confirm_columns(columns: DataFrame, run: str, column: str, code: str, status: str) -> DataFrame:
    """What becomes of each mapped column when its run is confirmed: outcome.

    A run with a pending column is incomplete as a whole. Of the columns of one code in one run the least is its
    representative and the others are in conflict with it; the representatives' labels are learned as aliases.
    """
    gates = columns.groupBy(run).agg(F.count_if(F.col(status) == "pending").alias("__pending"))
    shared = columns.where((F.col(status) == "confirmed") & F.col(code).isNotNull()).groupBy(run, code).agg(F.min(column).alias("__least"))
    joined = columns.join(gates, run).join(shared, [run, code], "left")
    outcome = (
        F.when(F.col("__pending") > 0, "incomplete")
        .when((F.col(status) != "confirmed") | F.col(code).isNull(), "ignored")
        .when(F.col(column) == F.col("__least"), "representative")
        .otherwise("conflict")
    )
    return joined.withColumn("outcome", outcome).drop("__pending", "__least")


def codeless(columns: DataFrame, label: str, code: str, cells: str) -> DataFrame:
    """The cells of columns without a code, one row for each entry of their map: label, row, value."""
    return columns.where(F.col(code).isNull()).select(F.col(label).alias("label"), F.explode(cells).alias("row", "value"))


def promote_checklist(facts: DataFrame, value: str, year: str, added: DataFrame, ready: Column) -> DataFrame:
    """One row before a run is promoted: n_rows, n_gaps (no value), default_year, n_added and n_ready of the added."""
    one = facts.agg(F.count("*").alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_gaps"), F.max(year).alias("default_year"))
    return one.crossJoin(added.agg(F.count("*").alias("n_added"), F.count_if(ready).alias("n_ready")))  # one row each


def first_keys(keys: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """One row: the first ``most`` keys in order, as an array."""
    return keys.orderBy(key).limit(most).agg(F.array_sort(F.collect_list(key)).alias(name))


def promote_card(year: int, active: DataFrame, key: str, facts: DataFrame, overrides: DataFrame, codeless: DataFrame, added: DataFrame, onboarded: Column, most: int = 15) -> DataFrame:
    """What is to be looked at once a year is promoted, as one row.

    active: the keys that should have a fact; facts: year and key; overrides, codeless: year; added: the run's new keys,
    of which ``onboarded`` says whether all is there. Gaps are active keys without a fact of the year; of them and of
    the new keys that are pending the first ``most`` are listed. A year without any fact is nobody's default.
    """
    gaps = active.select(key).distinct().join(facts.where(F.col("year") == year).select(key), key, "left_anti")
    pending = added.where(~F.coalesce(onboarded, F.lit(False)))
    of_year = lambda df, name: df.where(F.col("year") == year).agg(F.count("*").alias(name))
    row = facts.agg(F.max("year").alias("students_now_see"))
    for part in (
        gaps.agg(F.count("*").alias("coverage_gap_count")), first_keys(gaps, key, most, "coverage_gaps"), of_year(overrides, "stream_override_rows"), of_year(codeless, "codeless_rows"),
        added.agg(F.count("*").alias("new_total")), pending.agg(F.count("*").alias("new_pending_count")), first_keys(pending, key, most, "new_pending"),
    ):
        row = row.crossJoin(part)  # one row each
    default = F.coalesce(F.col("students_now_see") == year, F.lit(False))
    return row.select(
        F.lit(year).alias("promoted_year"), "students_now_see", default.alias("is_default_year"), "coverage_gap_count", "coverage_gaps", "stream_override_rows", "codeless_rows",
        "new_total", (F.col("new_total") - F.col("new_pending_count")).alias("new_onboarded"), "new_pending",
    )


def tab_groups(rows: DataFrame, by: Sequence[str], bucket: str, tabs: Sequence[str]) -> DataFrame:
    """How many rows of each group go to each tab, and the first tab in order that has any."""
    counts = rows.groupBy(*by).agg(*(F.count_if(F.col(bucket) == t).alias(f"n_{t}") for t in tabs))
    return counts.withColumn("default_tab", F.coalesce(*(F.when(F.col(f"n_{t}") > 0, t) for t in tabs)))


def next_state(state: Column, wanted: Column, allowed: Mapping[str, Sequence[str]] = RUN_STATES) -> Column:
    """The state a run goes to: the wanted one if its own state allows it, or its own."""
    may = F.lit(False)
    for name, following in allowed.items():
        may = may | ((state == name) & wanted.isin(*following))
    return F.when(may, wanted).otherwise(state)


def lookup(chunks: DataFrame, key: str, order: Sequence[str], text: str, facts: DataFrame, year: str, value: str, most: int = 60) -> DataFrame:
    """Each key's chunks in order as one text, and its value of the latest year, beneath each other: the first ``most`` rows by key and kind."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("__t"))))
    whole = chunks.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["__t"]), "\n").alias("said")).select(key, F.lit("content").alias("kind"), "said")
    latest = facts.groupBy(key).agg(F.max_by(value, F.struct(year, value)).alias("said")).select(key, F.lit("latest").alias("kind"), "said")
    both = whole.unionByName(latest)
    return both.orderBy(*(F.col(c) for c in both.columns[:2])).limit(most)


def route(text: Column, topics: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first topic, in order, one of whose words the text holds; or the default."""
    found = F.lit(None).cast("string")
    for topic, words in reversed(topics.items()):
        found = F.when(F.lower(text).rlike("|".join(rf"\b{w}" for w in words)), topic).otherwise(found)
    return F.coalesce(found, F.lit(default))


def have_and_missing(rows: DataFrame, by: str, present: Column) -> DataFrame:
    """How many rows of each group have what is asked for and how many lack it."""
    return rows.groupBy(by).agg(F.count_if(present).alias("have"), F.count_if(~present).alias("missing"))
