"""Thresholds, rules, scores and period comparisons over the driver's tables.

Orders stand for the facts: the price is the threshold, the order's year the period, the customer's nation the place;
the highest line price of a return flag overrides it, and lines with a status are the allow-list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions import columns as C
from cutline.operators import decisions as D
from cutline.operators import joins, presence
from cutline.operators.rules import Baskets, basket_rule, counted_gate, input_problem

from .registry import Tables, query

_CANDIDATES = """
ov AS (SELECT l_orderkey, max(CAST(l_extendedprice AS DECIMAL(12,2))) AS z FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
cand AS (SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS y, c_nationkey, coalesce(ov.z, CAST(o_totalprice AS DECIMAL(12,2))) AS cutoff
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN ov ON l_orderkey = o_orderkey
  WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_linestatus = 'O'))
"""


def _candidates(t: Tables, year: int | None = None, nation: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """Orders with an open line and their thresholds; the lines, read once, are cut to the orders of the year and nation first.

    ``among``: years and nations (y, c_nationkey) that are asked for.
    """
    orders = t.orders if year is None else t.orders.where(f"o_orderdate >= DATE '{year}-01-01' AND o_orderdate < DATE '{year + 1}-01-01'")
    places = t.customer if nation is None else t.customer.where(F.col("c_nationkey") == nation)
    facts = orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(12,2)").alias("base"))
    facts = facts.join(places.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    if among is not None:
        facts = facts.join(among.select("y", "c_nationkey").distinct(), ["y", "c_nationkey"], "left_semi")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice").cast("decimal(12,2)")).alias("z"), (F.col("l_linestatus") == "O").alias("open"))
    if year is not None or nation is not None or among is not None:
        lines = lines.join(facts.select("o_orderkey"), "o_orderkey", "left_semi")
    flagged = lines.groupBy("o_orderkey").agg(F.max("z").alias("z"), F.bool_or("open").alias("open")).where("open").drop("open")
    return facts.join(flagged, "o_orderkey").withColumn("cutoff", F.coalesce("z", "base")).drop("base", "z")


@query(f"""
WITH {_CANDIDATES}
SELECT o_orderkey, CAST(cutoff AS DOUBLE) AS cutoff, CAST(60000 - cutoff AS DOUBLE) AS margin,
  CASE WHEN 60000 - cutoff < 0 THEN 'near_miss' WHEN o_orderpriority = '1-URGENT' THEN 'conditional' ELSE 'eligible' END AS status,
  60000 - cutoff >= 0 AND 60000 - cutoff <= 15000 AS is_marginal
FROM cand WHERE y = 1998 AND c_nationkey = 3 AND cutoff <= 60000 + 40000
""")
def elig_core(t: Tables) -> DataFrame:
    """One profile against all candidates of its place and year."""
    rows = _candidates(t, 1998, 3).withColumn("z", F.lit("60000").cast("decimal(12,2)"))
    judged = D.decide(rows, "z", "cutoff", 40000, 15000, F.col("o_orderpriority") == "1-URGENT")
    return judged.select("o_orderkey", "cutoff", "margin", "status", "is_marginal").orderBy(F.desc("cutoff"), "o_orderkey")


_PROFILES = "p(profile_id, z, place, wanted) AS (VALUES (1, 60000, 3, 1998), (2, 90000, 5, 1997), (3, 20000, 3, 2030), (4, 120000, 11, 2002))"


def _profiles(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(1, 60000, 3, 1998), (2, 90000, 5, 1997), (3, 20000, 3, 2030), (4, 120000, 11, 2002)], "profile_id int, z int, place int, wanted int")
    return rows.withColumn("z", F.col("z").cast("decimal(12,2)"))


@query(f"""
WITH {_PROFILES}, {_CANDIDATES}, latest AS (SELECT max(year(o_orderdate)) AS y FROM orders),
u AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE year(o_orderdate) = wanted) THEN wanted ELSE latest.y END AS used FROM p, latest),
j AS (SELECT u.*, cutoff, o_orderpriority, z - cutoff AS margin, o_orderkey % 7 <> 0 AS passes FROM u JOIN cand ON c_nationkey = place AND cand.y = used WHERE cutoff <= z + 40000)
SELECT profile_id, CAST(used AS BIGINT) AS used_period, CASE WHEN wanted - used <= 0 THEN 'current' WHEN wanted - used = 1 THEN 'previous_year' ELSE 'estimated' END AS tier,
  count(*) FILTER (passes AND margin >= 0 AND o_orderpriority <> '1-URGENT') AS n_eligible, count(*) FILTER (passes AND margin >= 0 AND o_orderpriority = '1-URGENT') AS n_conditional,
  count(*) FILTER (passes AND margin < 0) AS n_near_miss, count(*) FILTER (NOT passes AND margin >= 0) AS n_gated
FROM j GROUP BY 1, 2, 3
""")
def elig_profiles_batch(t: Tables) -> DataFrame:
    """D01 in batch, F11, F12, A13: many profiles, each with its year, its counts and a gate."""
    facts = t.orders.select(F.year("o_orderdate").alias("y"))
    profiles = D.effective_period(_profiles(t), facts, "wanted", "y")
    asked = profiles.select(F.col("used_period").alias("y"), F.col("place").alias("c_nationkey"))
    rows = profiles.join(_candidates(t, among=asked), (F.col("place") == F.col("c_nationkey")) & (F.col("used_period") == F.col("y")))
    judged = D.decide(rows, "z", "cutoff", 40000, 15000, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 7 != 0)
    return D.decision_counts(judged.withColumn("used_period", F.col("used_period").cast("long")), ["profile_id", "used_period", "tier"])


_RULES = {
    "P": {"type": "and", "conditions": [{"type": "any_n_subjects", "count": 2}, {"type": "one_of_min_grade", "subjects": ["R", "A"], "min_grade": "C"}]},
    "F": {"type": "or", "conditions": [{"type": "subject_min_grade", "subject": "N", "min_grade": "B"}, {"type": "stream_is", "streams": ["1-URGENT"]}]},
    "O": {"type": "count_from_list", "subjects": ["A", "N"], "count": 2, "min_grade": "C"},
}


@query("""
WITH s AS (SELECT l_orderkey, list({'s': l_returnflag, 'g': CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END}) AS x FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE o_orderstatus
  WHEN 'P' THEN len(list_filter(x, lambda e: e.g >= 1)) >= 2 AND len(list_filter(x, lambda e: e.s IN ('R', 'A') AND e.g >= 2)) >= 1
  WHEN 'F' THEN len(list_filter(x, lambda e: e.s = 'N' AND e.g >= 3)) >= 1 OR o_orderpriority = '1-URGENT'
  WHEN 'O' THEN len(list_filter(x, lambda e: e.s IN ('A', 'N') AND e.g >= 2)) >= 2 ELSE true END AS passes
FROM orders JOIN s ON l_orderkey = o_orderkey
""")
def rule_tree(t: Tables) -> DataFrame:
    """Rule trees of all leaf kinds, chosen by the row's key, over one conditional count for each leaf."""
    q = F.col("l_quantity")
    grade = F.when(q < 10, "F").when(q < 20, "S").when(q < 30, "C").when(q < 40, "B").otherwise("A")
    counts, gate = counted_gate(F.col("o_orderstatus"), _RULES, F.col("l_returnflag"), grade, F.col("o_orderpriority"))
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*counts)
    return t.orders.join(s, "o_orderkey").select("o_orderkey", gate.alias("passes"))


_BASKETS = Baskets(
    core=("p0", "p1"), belief=("p2", "p3", "p4"), pairs=(("p2", "p3"),), arts=(("p5",), ("p6",)), national=("p7", "p8", "p9"), classical=("p10", "p11", "p12"), foreign=("p13", "p14", "p15")
)


@query("""
WITH l AS (SELECT l_orderkey, list(DISTINCT 'p' || (l_partkey % 16)) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 HAVING count(DISTINCT l_partkey % 16) = 3),
c AS (SELECT l_orderkey, n, len(list_intersect(n, ['p0', 'p1'])) AS core, len(list_intersect(n, ['p2', 'p3', 'p4'])) AS belief, len(list_intersect(n, ['p5', 'p6'])) AS arts,
 len(list_intersect(n, ['p7', 'p8', 'p9'])) AS nat, len(list_intersect(n, ['p10', 'p11', 'p12'])) AS cla, len(list_intersect(n, ['p13', 'p14', 'p15'])) AS fo FROM l),
e AS (SELECT *, nat = 3 AS ea, nat + cla + fo = 3 AND nat >= 1 AND cla >= 1 AND fo = 0 AS eb, nat + cla + fo = 2 AND belief + arts = 1 AS ec FROM c)
SELECT l_orderkey, belief <= 2 AND NOT (list_contains(n, 'p2') AND list_contains(n, 'p3')) AND arts <= 2 AND cla <> 3 AND fo <> 3 AND (nat + cla + fo <= 2 OR ea OR eb) AND (core > 0 OR ea OR eb OR ec) AS passes FROM e
""")
def basket_rule_query(t: Tables) -> DataFrame:
    """Caps by basket with their exceptions."""
    s = t.lineitem.where("l_quantity >= 10").select("l_orderkey", F.concat(F.lit("p"), (F.col("l_partkey") % 16).cast("string")).alias("subject")).distinct()
    s = s.groupBy("l_orderkey").agg(F.collect_list(F.struct("subject", F.lit("S").alias("grade"))).alias("subjects")).where(F.size("subjects") == 3)
    return s.select("l_orderkey", basket_rule(F.col("subjects"), _BASKETS).alias("passes"))


_WEIGHTS = {"z_margin": 0.4, "university": 0.2, "career": 0.25, "industry": 0.15}


@query("""
WITH r AS (SELECT s_suppkey, s_nationkey, s_acctbal, CAST((tanh(s_acctbal / 10000.0 * 4) + 1) / 2 AS DOUBLE) AS z_margin,
  CASE WHEN s_suppkey % 4 <> 0 THEN CASE WHEN s_nationkey IN (3, 7) THEN 1.0 WHEN n_regionkey = 1 THEN 0.5 ELSE 0.2 END END AS university,
  CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN contains(lower(n_name), 'a') THEN 0.5 ELSE 0.0 END + CASE WHEN contains(lower(n_name), 'i') THEN 0.5 ELSE 0.0 END END AS career
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
w AS (SELECT *, 0.4 + CASE WHEN university IS NULL THEN 0.0 ELSE 0.2 END + CASE WHEN career IS NULL THEN 0.0 ELSE 0.25 END AS a FROM r)
SELECT s_suppkey, CAST(round((0.4 / a * z_margin + coalesce(0.2 / a * university, 0) + coalesce(0.25 / a * career, 0)) * 100000) AS BIGINT) AS total FROM w
""")
def score_rank(t: Tables) -> DataFrame:
    """Scores that may not apply, weights renormalised over those that do; shown in whole steps of 1e-5."""
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    preferred = F.when(F.col("s_suppkey") % 4 != 0, F.array(F.lit(3), F.lit(7)))
    tags = F.when(F.col("s_suppkey") % 3 != 0, F.array(F.lit("a"), F.lit("i")))
    rows = rows.withColumns(
        {
            "z_margin": D.margin_score(F.col("s_acctbal") / 10000.0),
            "university": D.place_score(F.col("s_nationkey"), F.col("n_regionkey"), preferred, F.lit(1)),
            "career": D.tag_score(tags, F.array(F.col("n_name"))),
        }
    )
    total = D.weighted_total(D.Scoring({k: v for k, v in _WEIGHTS.items() if k != "industry"}), None)
    return rows.select("s_suppkey", F.round(total * 100000, 0).cast("long").alias("total"))


@query("""
WITH x AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS tags FROM part)
SELECT p_partkey, CAST(round(10000 * CASE WHEN p_partkey % 2 = 0 THEN d WHEN NOT m THEN 0.0 ELSE 0.7 + 0.3 * d END) AS BIGINT) AS demand FROM (
  SELECT p_partkey, list_max([CASE g WHEN 'brass' THEN 0.9 WHEN 'steel' THEN 0.7 WHEN 'promo' THEN 0.2 ELSE 0.45 END FOR g IN tags]) AS d, len(list_filter(tags, lambda g: contains(g, 'el') OR contains('el', g))) > 0 AS m FROM x)
""")
def demand_tags(t: Tables) -> DataFrame:
    """Demand from a table, a match, or both blended."""
    mine = F.when(F.col("p_partkey") % 2 != 0, F.array(F.lit("el")))
    score = D.demand_score(mine, F.split("p_type", " "), {"brass": 0.9, "steel": 0.7, "promo": 0.2})
    return t.part.select("p_partkey", F.round(score * 10000, 0).cast("long").alias("demand"))


@query("""
WITH o AS (SELECT o_custkey AS k, o_orderpriority AS m, max(CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS DECIMAL(18,4))) AS was FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1, 2),
n AS (SELECT o_custkey AS k, o_orderpriority AS m, max(CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS DECIMAL(18,4))) AS now FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 2),
known AS (SELECT c_custkey AS k, c_acctbal >= 0 AS active FROM customer WHERE c_custkey % 4 <> 0),
printed AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) >= 2000),
d AS (SELECT n.k, n.m, was, now, coalesce(abs(now - was) >= 100, (now IS NULL) <> (was IS NULL)) AS differs FROM n JOIN known ON known.k = n.k AND active LEFT JOIN o ON o.k = n.k AND o.m = n.m)
SELECT k AS o_custkey, 'removed' AS kind, 0::BIGINT AS n_members, 0::BIGINT AS n_changed, NULL::DOUBLE AS most, '' AS details FROM known WHERE active AND k NOT IN (SELECT k FROM n) AND k NOT IN (SELECT k FROM printed)
UNION ALL SELECT k, 'added', count(now), 0, NULL, '' FROM n WHERE k NOT IN (SELECT k FROM known) GROUP BY k
UNION ALL SELECT k, 'changed', count(*), count(*) FILTER (differs), coalesce(CAST(max(abs(now - was)) FILTER (differs) AS DOUBLE), 0),
  string_agg(m || ':' || coalesce(CAST(CAST(was AS DECIMAL(18,2)) AS VARCHAR), '-') || '>' || coalesce(CAST(CAST(now AS DECIMAL(18,2)) AS VARCHAR), '-'), ';' ORDER BY m) FILTER (differs) FROM d GROUP BY k HAVING count(*) FILTER (differs) > 0
""")
def removal_rule(t: Tables) -> DataFrame:
    """A catalog diff with details by member, in which what is printed elsewhere isn't removed."""
    def year(y: int, skipped: int) -> DataFrame:
        z = F.when(F.col("o_orderkey") % skipped != 0, F.col("o_totalprice")).cast("decimal(18,4)")
        return t.orders.where(C.in_year("o_orderdate", y)).groupBy("o_custkey", "o_orderpriority").agg(F.max(z).alias("z"))

    known = t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") >= 0).alias("is_active"))
    printed = t.orders.where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("o_custkey")
    found = presence.diff_with_book(year(1996, 7), year(1997, 5), known, "o_custkey", "o_orderpriority", "z", printed, "100")
    shown = lambda v: F.coalesce(v.cast("decimal(18,2)").cast("string"), F.lit("-"))
    return found.withColumn("details", F.array_join(F.transform("details", lambda d: F.concat(d["member"], F.lit(":"), shown(d["was"]), F.lit(">"), shown(d["now"]))), ";"))


@query("""
WITH s AS (SELECT c_custkey, c_nationkey, CAST(c_acctbal AS DECIMAL(12,2)) AS b, c_mktsegment IN ('BUILDING', 'MACHINERY') AS stated FROM customer)
SELECT c_nationkey, c_custkey, CASE WHEN b >= 6000 AND c_custkey % 10 >= 3 THEN 'safe' ELSE 'consider' END AS bucket,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN stated THEN CAST(b AS DOUBLE) ELSE CAST(c_custkey % 10 AS DOUBLE) END DESC, c_custkey) AS place
FROM s
""")
def bucket_and_rank(t: Tables) -> DataFrame:
    """Buckets by two thresholds, and an order that depends on the row's mode."""
    rows = t.customer.select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("decimal(12,2)").alias("b"), (F.col("c_custkey") % 10).alias("m"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("stated"))
    rows = rows.withColumn("bucket", D.bucket(F.col("b"), F.col("m"), D.Scoring({}, {"safe_score": 6000, "safe_margin": 3})))
    return D.ranked(rows, ["c_nationkey"], F.col("stated"), "b", "m", "c_custkey").select("c_nationkey", "c_custkey", "bucket", F.col("place").cast("long").alias("place"))


@query("""
WITH a AS (SELECT o_custkey, o_orderpriority, max(CAST(o_totalprice AS DECIMAL(18,4))) AS z FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderpriority, max(CAST(o_totalprice AS DECIMAL(18,4))) AS z FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 2),
f AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.o_custkey IS NOT NULL AS o, b.o_custkey IS NOT NULL AS n, a.z AS was, b.z AS now FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority)
SELECT o_custkey, CASE WHEN NOT bool_or(o) THEN 'added' WHEN NOT bool_or(n) THEN 'removed' WHEN count(*) FILTER (coalesce(abs(now - was) >= 100, (now IS NULL) <> (was IS NULL))) > 0 THEN 'changed' ELSE 'same' END AS kind,
  count(*) FILTER (coalesce(abs(now - was) >= 100, (now IS NULL) <> (was IS NULL))) AS changed, CAST(max(abs(now - was)) AS DOUBLE) AS most FROM f GROUP BY 1
""")
def catalog_diff(t: Tables) -> DataFrame:
    """Added, removed and changed keys with their largest change."""
    old, new = (t.orders.where(C.in_year("o_orderdate", y)).groupBy("o_custkey", "o_orderpriority").agg(F.max(F.col("o_totalprice").cast("decimal(18,4)")).alias("z")) for y in (1996, 1997))
    return D.catalog_diff(old, new, "o_custkey", "o_orderpriority", "z", "100")


@query("""
SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
""")
def coverage_gaps(t: Tables) -> DataFrame:
    """Active keys without a fact in either table."""
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return D.coverage_gaps(t.customer.where("c_acctbal > 0").select("c_custkey"), o.where(C.in_year("o_orderdate", 2001)), "c_custkey", o.where("o_orderpriority = '5-LOW'"))


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity < 10) AS plain, count(CASE WHEN l_quantity >= 10 THEN 1 END) AS taken, count(DISTINCT CASE WHEN l_quantity >= 10 THEN l_returnflag END) AS kinds FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT l_orderkey, n, taken = kinds AND plain <= 1 AS valid FROM g
""")
def conflict_groups(t: Tables) -> DataFrame:
    """Groups that break the rule of disjoint claims."""
    rows = t.lineitem.select("l_orderkey", F.when(F.col("l_quantity") >= 10, F.array("l_returnflag")).otherwise(F.array().cast("array<string>")).alias("streams"))
    return D.split_conflicts(rows, "l_orderkey", "streams")


@query("""
SELECT doc_id, CASE WHEN h IS NULL THEN 'missing' WHEN q IS NULL THEN 'not_indexed' WHEN ih <> h THEN 'stale' ELSE 'indexed' END AS status
FROM (SELECT d.doc_id, CASE WHEN n_chars < 100 THEN NULL ELSE sha256(text) END AS h, l.quality AS q, CASE WHEN l.quality = 1 THEN sha256(text) ELSE 'old' END AS ih FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
""")
def staleness_status(t: Tables) -> DataFrame:
    """State of an index against the documents' hashes."""
    d = t.documents.select("doc_id", F.when(F.col("n_chars") >= 100, F.sha2("text", 256)).alias("h"))
    full = t.documents.select("doc_id", F.sha2("text", 256).alias("full"))
    index = t.labels.join(full, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("full")).otherwise("old").alias("indexed_hash"))
    return D.staleness(d, index, "doc_id", "h").select("doc_id", "status")


@query("""
SELECT o_orderkey, upper(trim(o_orderstatus)) AS status, CAST(o_totalprice AS DECIMAL(12,2)) BETWEEN 1000 AND 400000 AND upper(trim(o_orderstatus)) IN ('F', 'O') AS valid FROM orders
""")
def validated_input(t: Tables) -> DataFrame:
    """normalised codes and domain checks, as a flag beside each row."""
    ok = F.col("o_totalprice").cast("decimal(12,2)").between(1000, 400000) & C.code("o_orderstatus").isin("F", "O")
    return t.orders.select("o_orderkey", C.code("o_orderstatus").alias("status"), ok.alias("valid"))


@query("""
WITH s AS (SELECT l_orderkey AS k, list({'s': CASE WHEN l_linenumber = 7 THEN '' ELSE l_shipmode END, 'g': g}) AS subjects FROM (SELECT *, 'm' || l_linestatus AS l_shipmode, (['a', 'B', 'C', 's', 'F', 'X', 'AA', 'b', 'c'])[l_partkey % 9 + 1] AS g FROM lineitem) GROUP BY 1),
r AS (SELECT o_orderkey, CAST(o_totalprice / 100000 - 2.2 AS DOUBLE) AS z, CASE WHEN o_orderkey % 13 <> 0 THEN 'P' || o_orderkey % 3 WHEN o_orderkey % 2 = 0 THEN '' END AS place, o_orderpriority AS stream, CASE WHEN o_orderkey % 3 > 0 THEN year(o_orderdate) END AS y, subjects FROM orders JOIN s ON k = o_orderkey)
SELECT o_orderkey, CASE WHEN NOT z BETWEEN -2 AND 4 THEN 'z out of range' WHEN coalesce(length(place), 0) < 1 THEN 'no place' WHEN y IS NOT NULL AND NOT y BETWEEN 2000 AND 2100 THEN 'period out of range' WHEN len(subjects) <> 3 THEN 'not three subjects'
  WHEN len(list_filter(subjects, lambda x: x.s = '')) > 0 THEN 'subject without a name' WHEN len(list_filter(subjects, lambda x: length(x.g) <> 1 OR upper(x.g) NOT IN ('F', 'S', 'C', 'B', 'A'))) > 0 THEN 'unknown grade' END AS problem FROM r
""")
def request_problems(t: Tables) -> DataFrame:
    """whole requests checked, with the first thing that is wrong: range, codes, period, three subjects, known grades."""
    grade = F.element_at(F.array(*map(F.lit, ("a", "B", "C", "s", "F", "X", "AA", "b", "c"))), (F.col("l_partkey") % 9).cast("int") + 1)
    subject = F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("m"), "l_linestatus"))
    subjects = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(subject.alias("subject"), grade.alias("grade"))).alias("subjects"))
    k = F.col("o_orderkey")
    place = F.when(k % 13 != 0, F.concat(F.lit("P"), (k % 3).cast("string"))).when(k % 2 == 0, "")
    problem = input_problem((F.col("o_totalprice") / 100000 - 2.2), place, F.col("o_orderpriority"), F.when(k % 3 > 0, F.year("o_orderdate")), F.col("subjects"))
    return t.orders.join(subjects, "o_orderkey").select("o_orderkey", problem.alias("problem"))
