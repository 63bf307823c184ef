"""Verdicts over urls: rules by host and path first, then trust and distrust that spread along links between hosts.

Every host starts with a share of trust, its pages that a rule allows, and one of distrust, its pages that a rule
blocks. Trust is passed along links (a host that trusted hosts link to is trusted); distrust is passed against them (a
host that links to blocked hosts is not). That is personalised PageRank from the two kinds of seeds, on the graph and on
its reverse. A link is an absolute one in a page's html; besides, each host links to the domain right above it, down to
two labels, so that a domain's state reaches its hosts and the other way about. Links of a host to itself don't count.
A host is blocked if its distrust is at least ``LEAST`` and more than its trust.

Ranks are integers, in parts of ``ONE``, and shares are rounded down: sums don't depend on the order in which tasks end,
so a lost executor changes no verdict. After ``ROUNDS`` rounds what is left to pass on is DAMPING ** ROUNDS of the seeds.

Pages of a host are counted on each task before they shuffle, and links are made distinct, so a host with a third of
all pages is one row of the graph. Null urls and those without ``://`` have an empty host and path, fit no rule, take no
part in the graph and are allowed, as are hosts that no seed reaches. Rows that repeat stay, each with its verdict, and
count as pages of their own. Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, small, stash

#: Parts of a whole; an integer sum of a thousand million hosts holds.
ONE = 1_000_000_000
#: Percent that is passed on, rounds, and the least distrust that blocks, in parts of ``ONE``.
DAMPING, ROUNDS, LEAST = 85, 16, ONE // 10

LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return _lower(host), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. A few rules, a condition each, the longest first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, start, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name, verdict = F.when(fits, at + start).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def links(pages: DataFrame) -> DataFrame:
    """Distinct links between hosts: a, b (a links to b)."""
    host, _ = host_and_path(F.col("url"))
    found = pages.where(F.contains("html", F.lit("//"))).select(host.alias("a"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), _lower))).alias("b"))
    return found.where("a <> '' AND b <> '' AND a <> b").distinct()


def domains(hosts: DataFrame) -> DataFrame:
    """Links of hosts to the domains above them, step by step, down to two labels: a, b."""
    labels = F.split("host", r"\.")
    chain = hosts.select(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")).alias("up"))
    steps = chain.where(F.size("up") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("up") - 1), lambda i: F.struct(F.element_at("up", i).alias("a"), F.element_at("up", i + 1).alias("b")))).alias("step"))
    return steps.select("step.*").where("a <> '' AND b <> ''").distinct()


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust and distrust in parts of ``ONE``.

    seeds: host (once each), trust and distrust to begin with. edges: a, b, distinct; trust goes from a to b, distrust
    from b to a, each a fixed part of it in equal shares.
    """
    ways = edges.select(F.col("a").alias("host"), F.col("b").alias("to"), F.lit(True).alias("along")).unionByName(edges.select(F.col("b").alias("host"), F.col("a").alias("to"), F.lit(False).alias("along")))
    ways = stash(ways, "ways")
    shares = ways.groupBy("host").agg(F.count(F.when(F.col("along"), 1)).alias("n_out"), F.count(F.when(~F.col("along"), 1)).alias("n_in"))
    ends = ways.select("host").distinct()
    start = seeds.join(ends, "host", "full").select("host", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("trust", "distrust")))
    start = stash(start.join(shares, "host", "left").select("host", "trust", "distrust", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in")), "seeds")
    given = lambda c: F.expr(f"({c} * {100 - DAMPING}) div 100")
    now = start.select("host", given("trust").alias("trust"), given("distrust").alias("distrust"), "n_out", "n_in")
    held = []
    for i in range(rounds):
        out = now.where("trust > 0 AND n_out > 0 OR distrust > 0 AND n_in > 0")
        part = F.when(F.col("along"), F.expr(f"(trust * {DAMPING}) div (100 * n_out)")).otherwise(F.expr(f"(distrust * {DAMPING}) div (100 * n_in)"))
        sent = ways.join(out, "host").select(F.col("to").alias("host"), "along", part.alias("part")).where("part > 0")
        got = sent.groupBy("host").agg(F.sum(F.when(F.col("along"), F.col("part")).otherwise(0)).alias("t"), F.sum(F.when(~F.col("along"), F.col("part")).otherwise(0)).alias("d"))
        now = start.join(got, "host", "left").select("host", (given("trust") + F.coalesce("t", F.lit(0))).alias("trust"), (given("distrust") + F.coalesce("d", F.lit(0))).alias("distrust"), "n_out", "n_in")
        if i % 4 == 3 or i == rounds - 1:  # lineage ends here
            now = stash(now, "ranks")
            held.append(now)
    drop(*held[:-1], ways, start)
    return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, and trust and distrust of the host, of each page (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    ruled = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, said = rule_for(F.col("host"), F.col("path"), rules)
    ruled = stash(ruled.withColumns({"rule": name, "said": said}), "ruled")
    counts = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("said") == "allow", 1)).alias("n_allow"), F.count(F.when(F.col("said") == "block", 1)).alias("n_block"))
    seeds = stash(counts.select("host", F.expr(f"n_allow * {ONE} div n").alias("trust"), F.expr(f"n_block * {ONE} div n").alias("distrust")), "seeds")
    linked = stash(links(pages), "links")
    known = seeds.select("host").unionByName(linked.select(F.explode(F.array("a", "b")).alias("host"))).distinct()
    ranks = spread(seeds, linked.unionByName(domains(known)).distinct())
    blocked = (F.col("distrust") >= LEAST * (100 - DAMPING) // 100) & (F.col("distrust") > F.col("trust"))
    found = ruled.join(small(ranks), "host", "left")
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"),
    )
