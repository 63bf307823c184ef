"""Reply trees as chat texts: root-to-leaf paths are enumerated by self-joins, ranked, and formatted one by one.

``best_paths`` doubles: after k self-joins each message knows its ancestor 2**k steps up, its depth and the sum of
scores on the way, so a conversation of n messages takes log2(n) joins. Leaves then stand for root-to-leaf paths,
are ranked by mean score (ties: the longer path, then the smaller id), and the messages of a chosen path are marked by
walking the same pointers from the leaf.

A message whose parent is missing is a root. Messages on a cycle, and those under one, have no root and are left out.
Rows that repeat (conv_id, id) count as one: the smallest by parent, role and text. Null texts and roles are empty,
null scores 0, rows with null conv_id or id are left out. Other columns are ignored; empty tables give empty results.

The template writes ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed for each turn.
In texts and roles a backslash is doubled and one is put into each control string, so that ``parse`` gets them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates in public use take as control, each escaped after its first character.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in reversed(CONTROLS):
        out = F.replace(out, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\~"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\~"), F.lit("\n")))


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """The ``paths`` best root-to-leaf paths of each tree: conv_id, leaf, path_rank, depth (0 at the root), role, text.

    messages: conv_id, id, parent, role, text, score. Each row's work is a few joins on (conv_id, id), which Spark
    splits where one conversation holds many rows.
    """
    ranked = Window.partitionBy("conv_id", "id").orderBy(F.asc_nulls_first("parent"), "role", "text")
    nodes = messages.where(F.col("conv_id").isNotNull() & F.col("id").isNotNull()).select(
        "conv_id", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")
    )
    nodes = stash(nodes.withColumn("nth", F.row_number().over(ranked)).where("nth = 1").drop("nth"), "messages")
    known = nodes.select("conv_id", F.col("id").alias("parent"), F.lit(True).alias("held"))
    steps = nodes.join(known, ["conv_id", "parent"], "left").select("conv_id", "id", F.when(F.col("held"), F.col("parent")).alias("up"), F.when(F.col("held"), F.lit(1)).otherwise(0).alias("depth"), F.col("score").alias("total"))
    steps = stash(steps, "steps")
    done, levels = steps.where("up IS NULL"), [steps.where("up IS NOT NULL")]
    most = nodes.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    while (1 << (len(levels) - 1)) < most:
        # only messages that haven't reached their root yet take another, doubled step
        now = levels[-1]
        above = now.unionByName(done).select("conv_id", F.col("id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.col("total").alias("sum"))
        further = now.join(above, ["conv_id", "up"]).select("conv_id", "id", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("sum")).alias("total"))
        further = stash(further, "steps")
        done = done.unionByName(further.where("up IS NULL"))
        levels.append(further.where("up IS NOT NULL"))
    reached = done.select("conv_id", "id", "depth", "total")
    parents = levels[0].select("conv_id", F.col("up").alias("id")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.desc("mean"), F.desc("depth"), "id")
    leaves = reached.join(parents, ["conv_id", "id"], "left_anti").withColumn("mean", F.col("total") / (F.col("depth") + 1))
    chosen = leaves.withColumn("path_rank", F.row_number().over(order)).where(F.col("path_rank") <= paths)
    marked = chosen.select("conv_id", F.col("id").alias("leaf"), "path_rank", "id")
    for level in reversed(levels):  # the longest jumps first: in the end every message of the path is marked once
        jumps = marked.join(level.select("conv_id", "id", "up"), ["conv_id", "id"])
        marked = stash(marked.unionByName(jumps.select("conv_id", "leaf", "path_rank", F.col("up").alias("id"))).distinct(), "marked")
    return marked.join(reached.select("conv_id", "id", "depth"), ["conv_id", "id"]).join(nodes.select("conv_id", "id", "role", "text"), ["conv_id", "id"]).select("conv_id", "leaf", "path_rank", "depth", "role", "text")


def format_paths(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each path: conv_id, leaf, formatted, loss_spans (start and end in code points of what is learned)."""
    written = turns.select(
        "conv_id", "leaf", "depth", F.col("role").isin(*loss_roles).alias("learned"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), F.lit(END + "\n").alias("tail"),
    )
    row = F.struct("depth", "learned", "head", "body", "tail")
    whole = written.groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def place(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["head"])
        end = begin + F.length(turn["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + F.length(turn["tail"])).alias("at"), F.when(turn["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return whole.select(
        "conv_id", "leaf",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], t["tail"])), "").alias("formatted"),
        F.aggregate("turns", empty, place)["spans"].alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of role and text."""
    cut = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(cut, F.lit(2), F.size(cut))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(head) + 2, F.length(piece) - F.length(head) - 1 - len(END) - 1)
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chain(conversations: DataFrame) -> DataFrame:
    """Messages of conversations whose rows follow each other by turn: each replies to the one before.

    Rows of one turn are ordered by role and text; rows without conv_id form no conversation.
    """
    by_turn = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    numbered = conversations.where("conv_id IS NOT NULL").withColumn("id", F.row_number().over(by_turn).cast("long"))
    return numbered.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
