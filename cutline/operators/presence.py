"""Whether codes and names stand anywhere in a book, by one automaton over its pages, and a catalog diff that heeds it.

A page is read twice, forward and reversed, since rotated pages come out back to front: once as it is, in search of
codes that no letter or digit touches, and once also without parentheses, in search of names without theirs. All codes
and names of a block of entries are one Aho-Corasick automaton, so a page is passed over once whatever their number.
Pages and entries are dealt into blocks, each pair of blocks a task's work; a page is a row, and a phrase that is broken
over two pages is not seen. Names of under ``LEAST`` characters and empty codes are never present.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions import columns as C

#: Fixed value: the shortest name that is looked for.
LEAST = 4
#: Entries of one automaton, and pages that it passes over in one task, on average.
BLOCK_ENTRIES, BLOCK_PAGES = 50_000, 2_000


def base_name(name: Column) -> Column:
    """A name as it is looked for: normalised, without the parenthetical at its end and without any other."""
    return C.without_parentheses(C.normal_label(C.last_parenthetical(F.trim(name))["base"]))


def _alone(text: str, end: int, size: int) -> bool:
    """Whether no letter A to Z and no digit stands beside the match that ends at ``end``."""
    beside = (text[end - size : end - size + 1] if end >= size else "") + text[end + 1 : end + 2]
    return not any(c.isascii() and c.isalnum() for c in beside)


def find_present(pages: DataFrame, text: str, entries: DataFrame, key: str, code: str, name: str) -> DataFrame:
    """The keys, once each, of the entries whose code or name stands on some page."""
    n_blocks, n_parts = (max(1, -(-df.count() // size)) for df, size in ((entries, BLOCK_ENTRIES), (pages, BLOCK_PAGES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    body = F.coalesce(F.col(text), F.lit(""))
    forward, backward = C.normal_label(body), C.normal_label(F.reverse(body))
    bodies = pages.select(forward.alias("__f"), backward.alias("__b"), C.without_parentheses(forward).alias("__fn"), C.without_parentheses(backward).alias("__bn"))
    bodies = bodies.distinct().withColumn("__part", F.pmod(F.xxhash64("__f"), F.lit(n_parts)).cast("int")).select("*", every(n_blocks).alias("__block"))
    asked = entries.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.upper(F.trim(F.coalesce(code, F.lit("")))).alias("__code"), base_name(F.coalesce(name, F.lit(""))).alias("__name"))
    asked = asked.distinct().withColumn("__block", F.pmod(F.xxhash64("__key"), F.lit(n_blocks)).cast("int")).select("*", every(n_parts).alias("__part"))

    def look(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        keys, codes, names = (wanted.column(c).to_pylist() for c in ("__key", "__code", "__name"))
        by_word: dict[str, list[tuple[int, bool]]] = {}
        for i, (c, n) in enumerate(zip(codes, names, strict=True)):
            if c:
                by_word.setdefault(c, []).append((i, True))
            if len(n) >= LEAST:
                by_word.setdefault(n, []).append((i, False))
        found: set[int] = set()
        if by_word:
            automaton = ahocorasick.Automaton()
            for word, owners in by_word.items():
                automaton.add_word(word, (len(word), owners))
            automaton.make_automaton()
            for column, as_code in (("__f", True), ("__b", True), ("__fn", False), ("__bn", False)):
                for said in texts.column(column).to_pylist():
                    for end, (size, owners) in automaton.iter(said):
                        for i, is_code in owners:
                            if i not in found and (not is_code or as_code and _alone(said, end, size)):
                                found.add(i)
        return pa.table({key: wanted.column("__key").combine_chunks().take(pa.array(sorted(found), pa.int64())) if len(wanted) else pa.array([], wanted.schema.field("__key").type)}, schema=pa.schema([(key, wanted.schema.field("__key").type)]))

    kind = entries.schema[key].dataType.simpleString()
    return bodies.groupBy("__block", "__part").cogroup(asked.groupBy("__block", "__part")).applyInArrow(look, f"{key} {kind}").distinct()


def diff_with_book(old: DataFrame, new: DataFrame, active: DataFrame, key: str, member: str, value: str, present: DataFrame | None = None, step: str = "0.0001") -> DataFrame:
    """What a new catalog of values changes: key, kind, n_members, n_changed, most and details.

    old, new: key, member and value, old ones of the period before; active: key and is_active of all known keys. Kinds: removed (active,
    not in the new catalog and, with ``present``, nowhere in the book), added (not known; n_members counts its values)
    and changed (active, in both, some member differs by ``step`` or in being null; details hold was and now of these,
    in order of the member). Other keys give no row.
    """
    known = active.groupBy(key).agg(F.bool_or("is_active").alias("active"))
    a = old.select(key, member, F.col(value).cast("decimal(18,4)").alias("was"))
    b = new.select(key, member, F.col(value).cast("decimal(18,4)").alias("now"), F.lit(True).alias("given"))
    offered = new.select(key).distinct()
    gone = known.where("active").join(offered, key, "left_anti")
    if present is not None:
        gone = gone.join(present.select(key), key, "left_anti")
    none = F.array().cast("array<struct<member:string,was:double,now:double>>")
    removed = gone.select(key, F.lit("removed").alias("kind"), F.lit(0).cast("long").alias("n_members"), F.lit(0).cast("long").alias("n_changed"), F.lit(None).cast("double").alias("most"), none.alias("details"))
    fresh = b.join(known, key, "left_anti").groupBy(key).agg(F.count("now").alias("n_members"))
    added = fresh.select(key, F.lit("added").alias("kind"), "n_members", F.lit(0).cast("long").alias("n_changed"), F.lit(None).cast("double").alias("most"), none.alias("details"))
    both = b.join(known.where("active").select(key), key).join(a, [key, member], "left")
    delta = F.abs(F.col("now") - F.col("was"))
    differs = F.coalesce(delta >= F.lit(step).cast("decimal(18,6)"), F.col("now").isNull() != F.col("was").isNull())
    row = F.struct(F.col(member).cast("string").alias("member"), F.col("was").cast("double").alias("was"), F.col("now").cast("double").alias("now"))
    changed = both.groupBy(key).agg(
        F.count("*").alias("n_members"), F.count_if(differs).alias("n_changed"), F.coalesce(F.max(F.when(differs, delta)), F.lit(0)).cast("double").alias("most"), F.array_sort(F.collect_list(F.when(differs, row))).alias("details")
    ).where("n_changed > 0")
    return removed.unionByName(added).unionByName(changed.select(key, F.lit("changed").alias("kind"), "n_members", "n_changed", "most", "details"))
