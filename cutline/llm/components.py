"""Connected components of an edge table by alternating large and small stars, with the state in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, stash


def _pair(u: Column, v: Column) -> Column:
    return F.struct(u.alias("u"), v.alias("v"))


def _two(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """Both pairs of every row: a union would read, and join, the rows twice."""
    return rows.select(F.inline(F.array(first, second)))


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _round(edges: DataFrame) -> DataFrame:
    """A large and a small star. Edges of one component stay in one; all go from a node to a lesser one.

    Between the stars nothing is made distinct: a large star has no more rows than there are edges.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    large = _least_neighbour(_two(edges, _pair(u, v), _pair(v, u))).where("v > u").select(v.alias("u"), m.alias("v")).where("u <> v")
    small = _least_neighbour(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return _two(small, _pair(v, m), _pair(u, m)).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Each node has one edge, to a node that has none: then that is the least of its component, and another round would change nothing."""
    ends = lambda node, out: F.struct(F.col(node).alias("node"), F.lit(out).alias("out"))
    nodes = _two(edges, ends("u", 1), ends("v", 0)).groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("n"))
    return not nodes.agg(F.max((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("n") > 1)))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """node and comp (its component's least node) of every node of ``edges`` (u, v); no edges give no rows."""
    edges = stash(edges.where("u <> v").distinct(), "edges")
    while True:
        further = stash(_round(edges), "edges")
        drop(edges)
        edges = further
        if _settled(edges):
            break
    tops = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("comp"))
    found = stash(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops), "components")
    drop(edges)
    return found
