"""Batch decisions: which candidates each profile reaches, how they score, and how they compare over periods."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SCALE = 4


def effective_period(profiles: DataFrame, facts: DataFrame, wanted: str, period: str) -> DataFrame:
    """The period each profile is judged by: its own where there are facts, or else the latest; with gap, tier and note.

    The latest period is one row and joined as such; the periods are a small distinct table.
    """
    periods = facts.select(F.col(period).alias("__p")).distinct()
    latest = periods.agg(F.max("__p").alias("__latest"))
    out = profiles.join(periods, F.col(wanted) == F.col("__p"), "left").crossJoin(latest)
    used = F.when(F.col("__p").isNotNull(), F.col(wanted)).otherwise(F.col("__latest"))
    gap = F.coalesce(F.col(wanted), F.col("__latest")) - used
    tier = F.when(gap <= 0, "current").when(gap == 1, "previous_year").otherwise("estimated")
    note = F.when(F.col(wanted).isNotNull() & F.col("__p").isNull(), F.format_string("no data for %d, %d used", F.col(wanted).cast("int"), F.col("__latest").cast("int")))
    return out.withColumns({"used_period": used, "tier": tier, "note": note}).drop("__p", "__latest")


def margin_of(z: Column, cutoff: Column) -> Column:
    """Margin rounded to four places before its sign counts, as DECIMAL: 0.00004 below the cutoff is at the cutoff."""
    return F.round(z.cast("decimal(18,8)") - cutoff.cast("decimal(18,8)"), SCALE).cast("decimal(18,4)")


def decide(candidates: DataFrame, z: str, cutoff: str, reach: float | str, marginal: float | str, conditional: Column, gate: Column | None = None) -> DataFrame:
    """Keep what lies within reach, classify it eligible, conditional or near_miss; ``gate`` false drops the row."""
    margin = margin_of(F.col(z), F.col(cutoff))
    held = candidates.where(F.col(cutoff).isNotNull() & (F.col(cutoff) <= F.col(z).cast("decimal(18,8)") + F.lit(str(reach)).cast("decimal(18,8)")))
    judged = held.withColumn("margin", margin).withColumn("passes", F.lit(True) if gate is None else gate)
    status = F.when(F.col("margin") < 0, "near_miss").when(conditional, "conditional").otherwise("eligible")
    is_marginal = (F.col("margin") >= 0) & (F.col("margin") <= F.lit(str(marginal)).cast("decimal(18,4)"))
    return judged.withColumn("status", status).withColumn("is_marginal", is_marginal)


def decision_counts(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of each outcome in one pass; a failed gate counts only where the margin would have done."""
    ok = F.col("passes")
    return judged.groupBy(*by).agg(
        *(F.count_if(ok & (F.col("status") == s)).alias(f"n_{s}") for s in ("eligible", "conditional", "near_miss")),
        F.count_if(~ok & (F.col("margin") >= 0)).alias("n_gated"),
    )


# --- scoring -------------------------------------------------------------------------------------------------------


def margin_score(margin: Column) -> Column:
    return (F.tanh(margin.cast("double") * 4) + 1) / 2


def place_score(place: Column, area: Column, preferred: Column, home: Column) -> Column:
    """1 where preferred, a half in the same area, 0.2 elsewhere; no preference: no score."""
    none = preferred.isNull() | (F.size(preferred) == 0)
    return F.when(~none, F.when(F.array_contains(preferred, place), 1.0).when(area == home, 0.5).otherwise(0.2))


def similarity_score(cosine: Column, low: float = 0.45) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine - low) / (1 - low)))


def _clean(tags: Column) -> Column:
    return F.array_distinct(F.transform(tags, lambda x: F.lower(F.trim(x))))


def _overlap(mine: Column, theirs: Column) -> Column:
    """How many of mine contain or are contained in one of theirs."""
    return F.size(F.filter(mine, lambda a: F.exists(theirs, lambda b: a.contains(b) | b.contains(a))))


def tag_score(profile_tags: Column, tags: Column) -> Column:
    mine, theirs = _clean(profile_tags), _clean(tags)
    some = (F.coalesce(F.size(profile_tags), F.lit(0)) > 0) & (F.coalesce(F.size(tags), F.lit(0)) > 0)
    return F.when(some, F.least(F.lit(1.0), _overlap(mine, theirs) / F.size(mine)))


def demand_score(profile_tags: Column, tags: Column, demand: dict[str, float], default: float = 0.45) -> Column:
    """Demand alone without a preference; 0 without a match; or else 0.7 of the match and 0.3 of the demand."""
    mine, theirs = _clean(profile_tags), _clean(tags)
    table = F.create_map(*(F.lit(x) for kv in demand.items() for x in kv)) if demand else None
    worth = lambda tag: F.lit(default) if table is None else F.coalesce(F.try_element_at(table, tag), F.lit(default))
    best = F.array_max(F.transform(theirs, worth))
    hits = _overlap(mine, theirs)
    stated = F.coalesce(F.size(profile_tags), F.lit(0)) > 0
    blended = 0.7 * F.least(F.lit(1.0), hits / F.size(mine)) + 0.3 * best
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.when(~stated, best).when(hits == 0, 0.0).otherwise(blended))


@dataclass
class Scoring:
    """Weights by dimension and thresholds; dimensions are named columns that are null where they don't apply."""

    weights: dict[str, float]
    thresholds: dict[str, float] = field(default_factory=lambda: {"safe_score": 0.6, "safe_margin": 0.10})


def weighted_total(config: Scoring, places: int | None = 4) -> Column:
    """Sum of w / (sum of the active w) * s over the dimensions that apply, each rounded first; None: not rounded."""
    active = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in config.weights.items()), F.lit(0.0))
    active = F.when(active == 0, 1.0).otherwise(active)
    parts = [F.when(F.col(k).isNotNull(), F.lit(w) / active * F.col(k)).otherwise(0.0) for k, w in config.weights.items()]
    parts = [p if places is None else F.bround(p, places) for p in parts]
    total = sum(parts[1:], parts[0])
    return total if places is None else F.bround(total, places)


def breakdown(config: Scoring) -> Column:
    """The dimensions that apply: name, weight, score, contribution."""
    active = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in config.weights.items()), F.lit(0.0))
    active = F.when(active == 0, 1.0).otherwise(active)
    rows = [
        F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("name"), F.bround(F.lit(w) / active, 4).alias("weight"), F.bround(F.col(k), 4).alias("score"), F.bround(F.lit(w) / active * F.col(k), 4).alias("contribution")))
        for k, w in config.weights.items()
    ]
    return F.array_compact(F.array(*rows))


def bucket(total: Column, margin: Column, config: Scoring) -> Column:
    safe = (total >= config.thresholds["safe_score"]) & (margin >= config.thresholds["safe_margin"])
    return F.when(safe, "safe").otherwise("consider")


def active_config(configs: DataFrame, default: Scoring) -> Scoring:
    """The latest active stored configuration, or the default: one row at most reaches the driver."""
    row = configs.where("is_active").orderBy(F.desc("version")).limit(1).first()
    return Scoring(dict(row["weights"]), dict(row["thresholds"])) if row else default


def ranked(scored: DataFrame, by: Sequence[str], preference: Column, score: str, cutoff: str, key: str) -> DataFrame:
    """Place in the profile's list: by score where a preference is stated, by cutoff otherwise; ties by key."""
    order = F.when(preference, F.col(score).cast("double")).otherwise(F.col(cutoff).cast("double"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order.desc(), key)))


# --- comparing periods and catalogs -------------------------------------------------------------------------------


def catalog_diff(old: DataFrame, new: DataFrame, key: str, member: str, value: str, step: str = "0.0001") -> DataFrame:
    """One row for each key: added, removed, changed or same, how many members changed and the largest change.

    A change is a null on one side, or a difference of at least ``step`` in DECIMAL.
    """
    a = old.select(key, member, F.col(value).cast("decimal(18,4)").alias("was"), F.lit(True).alias("in_old"))
    b = new.select(key, member, F.col(value).cast("decimal(18,4)").alias("now"), F.lit(True).alias("in_new"))
    both = a.join(b, [key, member], "full")
    delta = F.abs(F.col("now") - F.col("was"))
    differs = F.coalesce(delta >= F.lit(step).cast("decimal(18,6)"), F.col("now").isNull() != F.col("was").isNull())
    out = both.groupBy(key).agg(F.max("in_old").alias("o"), F.max("in_new").alias("n"), F.count_if(differs).alias("changed"), F.max(delta).alias("most"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("changed") > 0, "changed").otherwise("same")
    return out.select(key, kind.alias("kind"), "changed", "most")


def coverage_gaps(keys: DataFrame, facts: DataFrame, key: str, *more: DataFrame) -> DataFrame:
    """Keys without a fact in any of the tables."""
    out = keys
    for f in (facts, *more):
        out = out.join(f.select(key).distinct(), key, "left_anti")
    return out


def split_conflicts(columns: DataFrame, key: str, streams: str) -> DataFrame:
    """Groups of more than one column for a key: valid if at most one has no streams and none share one."""
    flat = F.flatten(F.collect_list(streams))
    grouped = columns.groupBy(key).agg(F.count("*").alias("n"), flat.alias("all"), F.count_if(F.size(streams) == 0).alias("plain"))
    disjoint = F.size("all") == F.size(F.array_distinct("all"))
    return grouped.where("n > 1").select(key, "n", (disjoint & (F.col("plain") <= 1)).alias("valid"))


def staleness(documents: DataFrame, index: DataFrame, on: str, content_hash: str) -> DataFrame:
    """missing, not_indexed, stale or indexed, from the document's own hash and the one that was indexed."""
    held = index.select(on, F.col("indexed_hash"), F.lit(True).alias("__held"))
    kind = F.when(F.col(content_hash).isNull(), "missing").when(F.col("__held").isNull(), "not_indexed").when(F.col("indexed_hash") != F.col(content_hash), "stale").otherwise("indexed")
    return documents.join(held, on, "left").withColumn("status", kind).drop("__held", "indexed_hash")


Dimension = tuple[str, Callable[[], Column]]


def recommend(judged: DataFrame, dimensions: Sequence[Dimension], config: Scoring, by: Sequence[str], preference: Column, cutoff: str, key: str) -> DataFrame:
    """Score, bucket and place the rows that passed: the whole recommendation in one plan."""
    rows = judged.where("passes AND status <> 'near_miss'").withColumns({name: build() for name, build in dimensions})
    rows = rows.withColumn("total", weighted_total(config)).withColumn("breakdown", breakdown(config))
    rows = rows.withColumn("bucket", bucket(F.col("total"), F.col("margin"), config))
    return ranked(rows, by, preference, "total", cutoff, key)




def recommend_profiles(judged: DataFrame, profile: str, dimensions: Sequence[Dimension], config: Scoring, preference: Column, cutoff: str, key: str, most: int = 50) -> DataFrame:
    """Recommendations of many profiles in one plan: profile, mode, place, key, total, bucket, breakdown, n_all.

    judged: a row for each profile and candidate with passes, status and margin. A profile with a preference gets its list
    by score, another one by cutoff, the highest first; the first ``most`` stay, n_all counts all of a profile's.
    """
    rows = judged.where("passes AND status <> 'near_miss'").withColumns({name: build() for name, build in dimensions})
    rows = rows.withColumns({"total": weighted_total(config), "breakdown": breakdown(config), "mode": F.when(preference, "preference").otherwise("normal")})
    rows = rows.withColumn("bucket", bucket(F.col("total"), F.col("margin"), config))
    placed = ranked(rows, [profile], F.col("mode") == "preference", "total", cutoff, key).where(F.col("place") <= most)
    counts = rows.groupBy(profile).agg(F.count("*").alias("n_all"))
    return placed.join(counts, profile).select(profile, "mode", "place", key, cutoff, "total", "bucket", "breakdown", "n_all")


def also_offered(offered: DataFrame, usable: DataFrame, on: Sequence[str], profile: str, key: str, most: int = 50) -> DataFrame:
    """Candidates that a profile may take but that have no usable value: profile, place (by key), key, n_all; the first ``most``.

    offered: profile and ``on``, once each; usable: ``on`` of the candidates with a value of their own or an override.
    """
    rest = offered.join(usable.select(*on).distinct(), list(on), "left_anti")
    first = rest.withColumn("place", F.row_number().over(Window.partitionBy(profile).orderBy(key))).where(F.col("place") <= most)
    return first.join(rest.groupBy(profile).agg(F.count("*").alias("n_all")), profile).select(profile, "place", key, "n_all")
