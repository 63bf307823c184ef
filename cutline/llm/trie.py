"""The trie of conversations' first turns, built level by level, and what it saves when shared turns are kept once.

A node stands for a distinct sequence of first turns and is known by its depth and the smallest conv_id that starts
with it. Per depth, conversations that still share their node with another are grouped by (node, next turn); each group
is a node of the next depth. A conversation that is alone in its group leaves the loop: what is left of it is a chain
without branches, written out at once. So there are as many levels as the longest prefix that two conversations share
has turns. Then leaves and savings are rolled up level by level, from the deepest to the root.

A turn that many conversations have next is counted on each task before it is shuffled; the rows that then learn their
group's id meet one row of it in a join, whose large partitions Spark splits. What a node's ending conversations are
hashed from is never one row: ids are sorted by range, joined into pieces, and the pieces stream through one hash.

Rows without conv_id form no conversation; null roles and texts are empty; rows of one turn are ordered by role and
text, repeated rows are turns of their own; other columns are ignored. Empty tables give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORDS, drop, new_path, register, stash

#: Bytes of joined ids in a piece.
PIECE = 1 << 16

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_EMPTY = hashlib.sha256(b"").hexdigest()


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (SHA-256 of role and text) and words of each turn; stashed.

    Positions come from ranges of rows and from the counts of the ranges before, so that a conversation of many rows
    takes as many tasks as it needs.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    key = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    # equal rows may lie in several ranges: they are interchangeable
    dealt = rows.withColumn("any", F.rand(0)).repartitionByRange(*order, "any").sortWithinPartitions(*order)
    dealt = stash(dealt.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), key.alias("key"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")), "dealt")
    runs = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"))
    found = stash(dealt.join(placed, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "key", "words"), "turns")
    drop(dealt)
    return found


def lengths(turns: DataFrame) -> DataFrame:
    """conv_id and length, its number of turns."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("length"))


def build(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (see ``_NODE``), and the conversations that end at each: conv_id and depth of the node, member.

    turns: conv_id, pos (1 to length, without gaps), key, words. convs: conv_id (once each) and length, 0 included.
    """
    spark = turns.sparkSession
    # rows of one position together, so that a level reads its own part of the files
    turns = stash(turns.select("conv_id", "pos", "key", "words").sortWithinPartitions("pos"), "turns")
    convs = stash(convs.select("conv_id", F.col("length").cast("long").alias("length")), "convs")
    nodes_at, ends_at = (register(spark, new_path(spark, x)) for x in ("nodes", "ends"))
    root, n = convs.agg(F.min("conv_id"), F.count("*")).first()
    nothing = spark.createDataFrame([], _NODE), spark.createDataFrame([], "conv_id long, depth long, member long")
    if not n:
        drop(turns, convs)
        return nothing
    live = convs.withColumn("node", F.lit(root))
    levels: list[DataFrame] = []
    while True:
        depth = len(levels)
        ended = live.where(f"length = {depth}").select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("conv_id").alias("member"))
        ended.write.parquet(f"{ends_at}/at{depth}")
        step = live.where(f"length > {depth}").join(turns.where(f"pos = {depth + 1}").drop("pos"), "conv_id")
        groups = step.groupBy("node", "key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("length").alias("length"))
        groups = stash(groups, "groups")
        levels.append(groups)
        if groups.where("n_convs > 1").isEmpty():
            break
        named = groups.where("n_convs > 1").select("node", "key", "child")
        below = stash(step.join(named, ["node", "key"]).select("conv_id", "length", F.col("child").alias("node")), "live")
        if depth:
            drop(live)
        live = below
    if len(levels) > 1:
        drop(live)
    drop(turns, convs)
    _write_chains(levels, nodes_at, ends_at)
    rolled = None
    for depth in range(len(levels) - 1, -1, -1):
        rolled = _roll_up(spark, levels, depth, root, n, rolled, nodes_at)
    drop(*levels)
    whole = spark.read.option("recursiveFileLookup", True)
    return whole.schema(_NODE).parquet(nodes_at), whole.schema(nothing[1].schema).parquet(ends_at)


def _write_chains(levels: list[DataFrame], nodes_at: str, ends_at: str) -> None:
    """Conversations that are alone below a node: a node for each of their remaining turns. Some levels at a time."""
    for k in range(0, len(levels), 32):
        marked = [g.where("n_convs = 1").withColumn("begun", F.lit(depth).cast("long")) for depth, g in enumerate(levels[k : k + 32], k + 1)]
        alone = reduce(DataFrame.unionByName, marked)
        each = alone.withColumn("depth", F.explode(F.sequence("begun", "length")))
        each.select(
            F.col("child").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("begun"), F.col("node")).otherwise(F.col("child")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        ).write.parquet(f"{nodes_at}/alone{k}")
        alone.select(F.col("child").alias("conv_id"), F.col("length").alias("depth"), F.col("child").alias("member")).write.parquet(f"{ends_at}/alone{k}")


def _roll_up(spark: SparkSession, levels: list[DataFrame], depth: int, root: int, n: int, below: DataFrame | None, nodes_at: str) -> DataFrame:
    """Write the shared nodes of one depth, with what their children report; the level above reads them again."""
    if depth == 0:
        own = spark.createDataFrame([(root, None, n, 0)], "conv_id long, parent_conv_id long, n_convs long, words long")
    else:
        own = levels[depth - 1].where("n_convs > 1").select(F.col("child").alias("conv_id"), F.col("node").alias("parent_conv_id"), "n_convs", "words")
    reports = levels[depth].where("n_convs = 1").select("node", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    if below is not None:
        reports = reports.unionByName(below.select(F.col("parent_conv_id").alias("node"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    told = reports.groupBy(F.col("node").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    own.join(told, "conv_id", "left").select(
        "conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).cast("long").alias("saved_tokens"),
    ).write.parquet(f"{nodes_at}/at{depth}")
    return spark.read.schema(_NODE).parquet(f"{nodes_at}/at{depth}")


def digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of each node at which a conversation ends: ids in ascending order, comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": [node[0]], "depth": [node[1]], "first": [first], "ids": [b",".join(held)]}, schema=pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())]))

        for batch in batches:
            for c, d, m in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "member")), strict=True):
                if held and ((c, d) != node or size >= PIECE):
                    yield out()
                    held, size = [], 0
                if not held:
                    node, first = (c, d), m
                held.append(b"%d" % m)
                size += len(held[-1]) + 1
        if held:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: [x[i] for x in done] for i, k in enumerate(("conv_id", "depth", "ends_sha256"))}, schema=pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))

        for batch in batches:
            for c, d, ids in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "ids")), strict=True):
                if (c, d) == node:
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (c, d), hashlib.sha256()
                state.update(ids)
            if len(done) >= 10_000:
                yield out()
                done = []
        if node:
            done.append((*node, state.hexdigest()))
        if done:
            yield out()

    order = ["conv_id", "depth", "member"]
    joined = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "conv_id long, depth long, first long, ids binary")
    return joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def with_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with ends_sha256; where no conversation ends, the digest of nothing."""
    return nodes.join(digests(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
