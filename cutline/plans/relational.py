"""Filters, joins, aggregates, windows, sets and reshaping over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions import columns as C
from cutline.operators import grid, joins, reshape, windows

from .registry import Tables, query


def _money(column: str):
    return F.col(column).cast("decimal(12,2)")


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE year(o_orderdate) = 1998 AND o_orderpriority = '1-URGENT' AND CAST(o_totalprice AS DECIMAL(12,2)) <= CAST(60000.00 AS DECIMAL(12,2)) + CAST(20000.00 AS DECIMAL(12,2))
""")
def bound_filters(t: Tables) -> DataFrame:
    """equality on bound parameters and a ceiling computed in DECIMAL, through named SQL parameters."""
    return t.spark.sql(
        "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderdate >= CAST(:first AS TIMESTAMP_NTZ) AND o_orderdate < CAST(:after AS TIMESTAMP_NTZ) AND o_orderpriority = :priority AND CAST(o_totalprice AS DECIMAL(12,2)) <= :z + :reach",
        args={"first": "1998-01-01", "after": "1999-01-01", "priority": "1-URGENT", "z": Decimal("60000.00"), "reach": Decimal("20000.00")},
        orders=t.orders,
    )


@query("""
SELECT p_partkey, p_name FROM part WHERE (p_name ILIKE '%an%' OR p_type ILIKE '%an%') AND p_size >= 10 AND starts_with(p_brand, 'Brand#1')
""")
def ilike_multi(t: Tables) -> DataFrame:
    """substring search over several columns, a prefix, and only the filters that are given."""
    wanted = C.all_of(C.search_any("an", "p_name", "p_type"), F.col("p_size") >= 10, F.col("p_brand").startswith("Brand#1"), C.search_any(None, "p_name"))
    return t.part.where(wanted).select("p_partkey", "p_name")


@query("""
SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 5, 9) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
""")
def in_list(t: Tables) -> DataFrame:
    """Membership in a short list, and in the keys of a table as a semi join."""
    held = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.where(C.isin_or_semi("c_nationkey", [1, 5, 9])).join(held, "c_custkey", "left_semi").select("c_custkey")


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -1 END FROM orders WHERE year(o_orderdate) = 1997)
""")
def null_aware_anti(t: Tables) -> DataFrame:
    """NOT IN, which a null on the right would empty."""
    right = t.orders.where(C.in_year("o_orderdate", 1997)).select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(-1).alias("held"))
    return joins.not_in(t.customer.select("c_custkey"), "c_custkey", right, "held")


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND year(o_orderdate) = 1996)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997)
""")
def also_offered(t: Tables) -> DataFrame:
    """Two chained anti joins."""
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    out = t.customer.select("c_custkey")
    for gone in ((F.col("o_orderstatus") == "F") & C.in_year("o_orderdate", 1996), (F.col("o_orderpriority") == "1-URGENT") & C.in_year("o_orderdate", 1997)):
        out = out.join(o.where(gone), "c_custkey", "left_anti")
    return out


@query("""
WITH latest AS (SELECT max(year(o_orderdate)) AS y FROM orders)
SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n_lines,
  EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS returned,
  EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN latest WHERE l_partkey = p_partkey AND year(o_orderdate) = y) AS sold_latest,
  CAST((CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') THEN 1 ELSE 0 END)
   + (CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN latest WHERE l_partkey = p_partkey AND year(o_orderdate) = y) THEN 1 ELSE 0 END)
   + (CASE WHEN p_size > 40 THEN 1 ELSE 0 END) AS BIGINT) AS n_blockers
FROM part
""")
def onboarding_flags(t: Tables) -> DataFrame:
    """Counts and existence flags by part, and how many things block it."""
    lines = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    latest = t.orders.agg(F.max(F.year("o_orderdate")).alias("y"))
    sold = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(latest, F.year("o_orderdate") == F.col("y"), "left_semi")
    out = joins.count_of(t.part, lines, ["p_partkey"], "n_lines")
    out = joins.exists_flag(out, lines.where("l_returnflag = 'R'"), ["p_partkey"], "returned")
    out = joins.exists_flag(out, sold, ["p_partkey"], "sold_latest")
    blockers = F.array_compact(F.array(F.when(~F.col("returned"), "returned"), F.when(~F.col("sold_latest"), "sold"), F.when(F.col("p_size") > 40, "size")))
    return out.select("p_partkey", "n_lines", "returned", "sold_latest", F.size(blockers).cast("long").alias("n_blockers"))


@query("""
WITH f AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT c.conv_id, c.messages, left(coalesce(f.text, '—'), 80) AS preview, l.last_turns
FROM (SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id) c
LEFT JOIN (SELECT * FROM f WHERE n = 1) f USING (conv_id)
LEFT JOIN (SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS last_turns FROM l WHERE n <= 3 GROUP BY conv_id) l USING (conv_id)
""")
def first_last_message(t: Tables) -> DataFrame:
    """Counts, the first user message as a preview, and the last three turns in order."""
    c = t.conversations
    base = c.groupBy("conv_id").agg(F.count("*").alias("messages"))
    with_first = joins.top_one(base, c.where("role = 'user'"), ["conv_id"], [F.col("turn")], ["text"])
    last = windows.last_rows(c, ["conv_id"], "turn", 3).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda x: x.cast("string")), ",").alias("last_turns"))
    return with_first.join(last, "conv_id", "left").select("conv_id", "messages", C.preview("text", 80).alias("preview"), "last_turns")


@query("""
SELECT n_nationkey, coalesce((SELECT string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers FROM nation
""")
def nested_array(t: Tables) -> DataFrame:
    """Sorted values of the other table in each row, none as an empty list (shown as text)."""
    s = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return joins.nested_array(t.nation.select("n_nationkey"), s, ["n_nationkey"], "s_suppkey", "suppliers").select("n_nationkey", F.array_join(F.transform("suppliers", lambda x: x.cast("string")), ",").alias("suppliers"))


@query("""
SELECT r_name, string_agg(n_name, ' | ' ORDER BY n_nationkey) AS nations, string_agg(DISTINCT left(n_name, 1), ',' ORDER BY left(n_name, 1)) AS initials, count(*) AS n
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
""")
def listagg_by_group(t: Tables) -> DataFrame:
    """Text joined in order of a key, and sorted distinct values."""
    joined = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return joined.groupBy("r_name").agg(F.array_join(names, " | ").alias("nations"), F.array_join(F.sort_array(F.collect_set(F.left("n_name", F.lit(1)))), ",").alias("initials"), F.count("*").alias("n"))


@query("""
SELECT k, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL GROUP BY k
""")
def json_unnest_usage(t: Tables) -> DataFrame:
    """Values inside JSON, unnested only where the type is right, counted."""
    parsed = t.events.select(F.explode(F.map_values(F.from_json("props", "map<string,bigint>"))).alias("k"))
    return parsed.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))


@query("""
SELECT p_brand, min(p_size) AS smallest, string_agg(DISTINCT CAST(s_nationkey AS VARCHAR), ',' ORDER BY CAST(s_nationkey AS VARCHAR)) AS nations, count(DISTINCT l_suppkey) AS suppliers
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_brand
""")
def bridge_rollup(t: Tables) -> DataFrame:
    """A chain of left joins over a bridge, then an aggregate; the bridge is made distinct first."""
    bridge = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    joined = t.part.join(bridge, F.col("l_partkey") == F.col("p_partkey"), "left").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    nations = F.array_join(F.sort_array(F.collect_set(F.col("s_nationkey").cast("string"))), ",")
    return joined.groupBy("p_brand").agg(F.min("p_size").alias("smallest"), nations.alias("nations"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""
SELECT year(o_orderdate) AS y, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished,
  CAST(max(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS top, y = (SELECT max(year(o_orderdate)) FROM orders) AS latest
FROM orders GROUP BY year(o_orderdate)
""")
def year_stats(t: Tables) -> DataFrame:
    """Counts, distinct counts, conditional counts, and a flag of the latest year."""
    years = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.max(_money("o_totalprice")).alias("top")
    )
    latest = t.orders.agg(F.max(F.year("o_orderdate")).alias("last"))
    return years.join(latest, F.col("y") == F.col("last"), "left").select("y", "n", "customers", "finished", "top", F.col("last").isNotNull().alias("latest"))


@query("""
SELECT count(*) AS n, count(DISTINCT user_id) AS users, CAST(trunc(coalesce(avg(CAST(value AS DECIMAL(18,6))), 0)) AS BIGINT) AS mean_value, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-20') AS today, event_type
FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAYS AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type
""")
def usage_dashboard(t: Tables) -> DataFrame:
    """The last seven days before a given moment, by type."""
    as_of = "2024-01-20 12:00:00"
    recent = t.events.where(C.within_days("ts", as_of, 7) & (F.col("ts") <= F.lit(as_of).cast("timestamp_ntz")))
    mean = F.coalesce(F.avg(F.col("value").cast("decimal(18,6)")), F.lit(0)).cast("long")  # cut off, not rounded
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), mean.alias("mean_value"), F.count_if(C.same_day("ts", as_of)).alias("today"))


@query("""
SELECT o_custkey, string_agg(CAST(y AS VARCHAR) || '=' || CAST(z AS VARCHAR), ';' ORDER BY y) AS history
FROM (SELECT o_custkey, year(o_orderdate) AS y, max(CAST(o_totalprice AS DECIMAL(12,2))) AS z FROM orders GROUP BY 1, 2) GROUP BY o_custkey
""")
def map_history(t: Tables) -> DataFrame:
    """Year to value as a map per key, shown as text."""
    per = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.max(_money("o_totalprice")).alias("z"))
    mapped = reshape.history_map(per, ["o_custkey"], "y", "z", "m")
    return mapped.select("o_custkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ";").alias("history"))


@query("""
SELECT o_orderpriority, CAST(max(CASE WHEN year(o_orderdate) = 1996 THEN CAST(o_totalprice AS DECIMAL(12,2)) END) AS DOUBLE) AS "1996",
  CAST(max(CASE WHEN year(o_orderdate) = 1997 THEN CAST(o_totalprice AS DECIMAL(12,2)) END) AS DOUBLE) AS "1997", CAST(max(CASE WHEN year(o_orderdate) = 1998 THEN CAST(o_totalprice AS DECIMAL(12,2)) END) AS DOUBLE) AS "1998"
FROM orders GROUP BY o_orderpriority
""")
def pivot_matrix(t: Tables) -> DataFrame:
    """Long to wide over known years."""
    per = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").cast("string").alias("y")).agg(F.max(_money("o_totalprice")).alias("z"))
    return reshape.to_matrix(per, ["o_orderpriority"], "y", ["1996", "1997", "1998"], "z")


@query("""
SELECT s_suppkey, 'balance' AS label, CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS cell FROM supplier
UNION ALL SELECT s_suppkey, 'name', s_name FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier
""")
def unpivot_long(t: Tables) -> DataFrame:
    """Wide to long."""
    wide = t.supplier.select("s_suppkey", _money("s_acctbal").cast("string").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    return reshape.to_long(wide, ["s_suppkey"], ["balance", "name", "nation"], "label", "cell")


@query("""
SELECT o_orderkey, r, stream FROM (SELECT o_orderkey, unnest(['status', 'priority']) AS r FROM orders), (SELECT unnest(['A', 'B']) AS stream)
""")
def cells_by_stream(t: Tables) -> DataFrame:
    """A map of cells times an array of streams."""
    cells = t.orders.select("o_orderkey", F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")).alias("cells"), F.array(F.lit("A"), F.lit("B")).alias("streams"))
    return reshape.cells_by_stream(cells, ["o_orderkey"], "cells", "streams").select("o_orderkey", F.col("row").alias("r"), "stream")


@query("""
SELECT event_id, pos - 1 AS pos, h AS header, v AS value FROM (SELECT event_id, unnest(['type', 'user']) AS h, unnest([event_type, CAST(user_id AS VARCHAR)]) AS v, unnest([1, 2]) AS pos FROM events)
""")
def zip_headers(t: Tables) -> DataFrame:
    """Headers and values by position."""
    rows = t.events.select("event_id", F.array(F.lit("type"), F.lit("user")).alias("h"), F.array("event_type", F.col("user_id").cast("string")).alias("v"))
    return reshape.zip_headers(rows, ["event_id"], "h", "v")


@query("""
WITH p AS (SELECT o_custkey, year(o_orderdate) AS y, max(CAST(o_totalprice AS DECIMAL(12,2))) AS z FROM orders GROUP BY 1, 2),
d AS (SELECT *, z - lag(z) OVER (PARTITION BY o_custkey ORDER BY y) AS delta FROM p)
SELECT o_custkey, y, CAST(z AS DOUBLE) AS z, CAST(delta AS DOUBLE) AS delta, CASE WHEN abs(delta) <= 5000 THEN 'same' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' END AS trend FROM d
""")
def yoy_delta_band(t: Tables) -> DataFrame:
    """Change against the nearest earlier year, in a band."""
    per = t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("y")).agg(F.max(_money("o_totalprice")).alias("z"))
    return windows.delta_band(per, ["o_custkey"], "y", "z", "5000")


@query("""
WITH e AS (SELECT user_id, event_id, epoch(ts) AS s, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS p FROM events),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n FROM i GROUP BY 1, 2
""")
def islands_gap(t: Tables) -> DataFrame:
    """Runs of events with gaps of at most half a day."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    e = t.events.select("user_id", "event_id", seconds.alias("s"))
    return windows.islands(e, ["user_id"], "s", F.lit(43200)).groupBy("user_id", "island").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT DISTINCT user_id, day(ts) AS d FROM events), g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM d),
r AS (SELECT user_id, min(d) AS a, max(d) AS b FROM g GROUP BY user_id, g)
SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS spec FROM r GROUP BY user_id
""")
def islands_pages(t: Tables) -> DataFrame:
    """Consecutive numbers as a compact spec."""
    return windows.number_ranges(t.events.select("user_id", F.dayofmonth("ts").alias("d")), ["user_id"], "d")


@query("""
WITH RECURSIVE o AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders),
a AS (SELECT o_custkey, min(d) AS anchor FROM o GROUP BY 1 UNION ALL SELECT a.o_custkey, min(o.d) FROM a JOIN o ON o.o_custkey = a.o_custkey AND o.d > a.anchor + 200 GROUP BY a.o_custkey)
SELECT o_custkey, count(*) AS n, string_agg(CAST(anchor AS VARCHAR), ',' ORDER BY anchor) AS anchors FROM a GROUP BY o_custkey
""")
def anchored_runs(t: Tables) -> DataFrame:
    """Orders within 200 days of the first of their cluster, by customer; shown by the days that begin one."""
    days = t.orders.select("o_custkey", F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("d")).distinct()
    found = windows.anchored_clusters(days, ["o_custkey"], "d", 200.0)
    first = F.transform("clusters", lambda c: F.element_at(c, 1).cast("long").cast("string"))
    return found.select("o_custkey", F.size("clusters").cast("long").alias("n"), F.array_join(first, ",").alias("anchors"))


@query("""
SELECT conv_id, turn, role, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), true) AS header FROM conversations
""")
def header_breaks(t: Tables) -> DataFrame:
    """Where the key changes in a sorted run."""
    return windows.key_changes(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role")


@query("""
WITH s AS (SELECT l_partkey, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS total FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS n, lead(l_suppkey) OVER w AS runner_up, lead(total) OVER w AS runner_up_score FROM s WINDOW w AS (PARTITION BY l_partkey ORDER BY total DESC, l_suppkey))
SELECT l_partkey, l_suppkey, CAST(total AS DOUBLE) AS total, runner_up, CAST(runner_up_score AS DOUBLE) AS runner_up_score, CAST(total - coalesce(runner_up_score, 0) AS DOUBLE) AS margin FROM r WHERE n = 1
""")
def best_runner_up(t: Tables) -> DataFrame:
    """The best candidate, the best other, the margin."""
    rows = windows.dealt(t.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice"), ["l_partkey"])
    s = rows.groupBy("l_partkey", "l_suppkey").agg(F.sum(_money("l_extendedprice")).alias("total"))
    return windows.best_and_runner_up(s, ["l_partkey"], "l_suppkey", "total")


@query("""
SELECT text_sha, min(doc_id) AS doc_id, count(*) - 1 AS repeats FROM (SELECT doc_id, sha256(text) AS text_sha FROM documents) GROUP BY text_sha
""")
def dedupe_first(t: Tables) -> DataFrame:
    """Keep the first row of an identity, count the repeats."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("text_sha"))
    return windows.first_and_count(d, ["text_sha"], "doc_id", "repeats")


@query("""
SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM pages) WHERE n = 1
""")
def dedupe_urls(t: Tables) -> DataFrame:
    """Ordered dedupe by URL, the first stays."""
    return windows.first_of(t.pages.select("page_id", "url"), ["url"], [F.col("page_id")])


@query("""SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size > 25) AS total FROM part WHERE p_size > 25 ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40""")
def page_offset(t: Tables) -> DataFrame:
    """A page with the total."""
    rows, total = reshape.page(t.part.where("p_size > 25"), [F.col("p_name"), F.col("p_partkey")], 20, 40)
    return rows.select("p_partkey", "p_name").crossJoin(total)


@query("""
SELECT c_custkey, n AS rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END ASC NULLS LAST, c_custkey) AS n FROM customer) WHERE n <= 50
""")
def nulls_last(t: Tables) -> DataFrame:
    """Nulls last, said outright; a top-k report."""
    b = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("b")).orderBy(F.asc_nulls_last("b"), "c_custkey").limit(50)
    rows = b.agg(F.array_sort(F.collect_list(F.struct(F.col("b").isNull().alias("none"), "b", "c_custkey"))).alias("r"))
    return rows.select(F.posexplode("r").alias("i", "x")).select("x.c_custkey", (F.col("i") + 1).cast("long").alias("rank"))


@query("""SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS number FROM part WHERE CAST(regexp_extract(p_brand, '[0-9]+') AS INT) > 20 ORDER BY number, p_partkey LIMIT 100""")
def order_cast(t: Tables) -> DataFrame:
    """Order by a cast."""
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    return t.part.select("p_partkey", number.alias("number")).where("number > 20").orderBy("number", "p_partkey").limit(100)


@query("""
SELECT o_orderkey AS key, CAST(NULL AS VARCHAR) AS flag, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS z FROM orders WHERE year(o_orderdate) = 1998
UNION ALL SELECT l_orderkey, l_returnflag, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) FROM lineitem WHERE year(l_shipdate) = 1998
""")
def union_padded(t: Tables) -> DataFrame:
    """Rows of two kinds; what one lacks is null."""
    general = t.orders.where(C.in_year("o_orderdate", 1998)).select(F.col("o_orderkey").alias("key"), _money("o_totalprice").alias("z"))
    special = t.lineitem.where(C.in_year("l_shipdate", 1998)).select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("flag"), _money("l_extendedprice").alias("z"))
    return reshape.padded_union(special, general).select("key", "flag", "z")


@query("""
SELECT o_custkey, 'both' AS side FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
UNION ALL SELECT o_custkey, 'first' FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
""")
def set_algebra(t: Tables) -> DataFrame:
    """Distinct, intersection and difference of keys."""
    a, b = (t.orders.where(C.in_year("o_orderdate", y)).select("o_custkey") for y in (1996, 1997))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


@query("""
WITH b AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS f, list_sort(list_distinct(list(l_linestatus))) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(list_intersect(f, ['A', 'N'])) AS common, len(list_filter(f, lambda x: NOT list_contains(['A', 'N'], x))) AS others, len(f) = len(list_distinct(list_concat(f, ['A', 'N', 'R']))) AS everything, list_has_any(f, ['R']) AS any_r
FROM b
""")
def array_algebra(t: Tables) -> DataFrame:
    """Intersections, differences, equality and overlap of arrays."""
    known = F.array(F.lit("A"), F.lit("N"))
    b = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return b.select(
        "l_orderkey", F.size(F.array_intersect("f", known)).cast("long").alias("common"), F.size(F.array_except("f", known)).cast("long").alias("others"),
        C.set_equal(F.col("f"), F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("everything"), F.arrays_overlap("f", F.array(F.lit("R"))).alias("any_r"),
    )


@query("""
WITH a AS (SELECT o_custkey, max(CAST(o_totalprice AS DECIMAL(12,2))) AS z FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey, max(CAST(o_totalprice AS DECIMAL(12,2))) AS z FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CAST(a.z AS DOUBLE) AS left_value, CAST(b.z AS DOUBLE) AS right_value, CASE WHEN b.o_custkey IS NULL THEN 'left' WHEN a.o_custkey IS NULL THEN 'right' ELSE 'both' END AS side
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
""")
def full_compare(t: Tables) -> DataFrame:
    """Both key sets in one full outer join."""
    a, b = (t.orders.where(C.in_year("o_orderdate", y)).groupBy("o_custkey").agg(F.max(_money("o_totalprice")).alias("z")) for y in (1996, 1997))
    return joins.full_compare(a, b, ["o_custkey"], "z")


@query("""
SELECT c_custkey, CAST(c_acctbal_dec AS DOUBLE) AS c_acctbal_dec FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal_dec FROM customer) c
LEFT JOIN (SELECT o_custkey, max(CAST(o_totalprice AS DECIMAL(12,2))) AS z FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey WHERE o_custkey IS NULL OR c_acctbal_dec <> z
""")
def missing_or_different(t: Tables) -> DataFrame:
    """Rows that the other side lacks or holds otherwise."""
    o = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(_money("o_totalprice")).alias("z"))
    return joins.missing_or_different(t.customer.select("c_custkey", _money("c_acctbal").alias("c_acctbal_dec")), o, ["c_custkey"], "c_acctbal_dec", "z")


@query("""
WITH x AS (SELECT o_orderkey, o_orderstatus, day(o_orderdate) + 0.0 AS at FROM orders), c AS (SELECT unnest([1, 2, 3]) AS target, unnest([5.0, 15.0, 25.0]) AS at),
p AS (SELECT o_orderkey, target, abs(x.at - c.at) AS d, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(x.at - c.at), target) AS n FROM x, c)
SELECT o_orderkey, CASE WHEN d <= 4.5 THEN target END AS nearest FROM p WHERE n = 1
""")
def nearest_tolerance(t: Tables) -> DataFrame:
    """Each item's nearest target within a distance, ties to the lower one, the few targets being one array beside each row."""
    targets = F.array(*(F.struct(F.lit(k).alias("target"), F.lit(x).alias("spot")) for k, x in ((1, 5.0), (2, 15.0), (3, 25.0))))
    at = F.dayofmonth("o_orderdate").cast("double")
    best = F.array_min(F.transform(targets, lambda x: F.struct(F.abs(x["spot"] - at).alias("d"), x["target"].alias("target"))))
    return t.orders.select("o_orderkey", F.when(best["d"] <= 4.5, best["target"]).alias("nearest"))


@query("""
WITH b AS (SELECT * FROM (VALUES (1, 1.0, 8.0), (2, 12.0, 18.0), (3, 24.0, 31.0)) v(band, low, high)),
x AS (SELECT o_orderkey, day(o_orderdate) + 0.0 AS spot FROM orders)
SELECT o_orderkey, band FROM (SELECT o_orderkey, band, row_number() OVER (PARTITION BY o_orderkey ORDER BY greatest(low - spot, spot - high, 0.0), band) AS n FROM x, b) WHERE n = 1
""")
def nearest_band(t: Tables) -> DataFrame:
    """The band of least distance, ties to the first; the few bands are one array beside each row."""
    at = F.dayofmonth("o_orderdate").cast("double")
    return t.orders.select("o_orderkey", _least_band(lambda b: F.greatest(b["low"] - at, at - b["high"], F.lit(0.0))).alias("band"))


def _least_band(cost: Callable[[Column], Column]) -> Column:
    bands = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for b, lo, hi in ((1, 1.0, 8.0), (2, 12.0, 18.0), (3, 24.0, 31.0))))
    return F.array_min(F.transform(bands, lambda b: F.struct(cost(b).alias("d"), b["band"].alias("band"))))["band"]


@query("""
WITH b AS (SELECT * FROM (VALUES (1, 1.0), (2, 12.0), (3, 24.0)) v(band, low)), x AS (SELECT o_orderkey, day(o_orderdate) + 0.0 AS spot FROM orders)
SELECT o_orderkey, band FROM (SELECT o_orderkey, band, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN low >= spot THEN low - spot ELSE (spot - low) * 10 END, band) AS n FROM x, b) WHERE n = 1
""")
def penalised_band(t: Tables) -> DataFrame:
    """The band that a label before it belongs to: overshooting a band's edge costs ten times the gap to it."""
    return t.orders.select("o_orderkey", _least_band(lambda b: grid.label_band(F.dayofmonth("o_orderdate").cast("double"), b["low"])).alias("band"))


@query("""
WITH RECURSIVE i AS (SELECT c_nationkey AS g, c_custkey AS item, c_acctbal AS at, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS n FROM customer),
t AS (SELECT s_nationkey AS g, list({'at': s_acctbal, 'key': s_suppkey, 'r': r}) AS l FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r FROM supplier) GROUP BY 1),
s AS (
  SELECT g, n, item, pick, CASE WHEN pick IS NULL THEN CAST([] AS BIGINT[]) ELSE [pick] END AS used FROM (
    SELECT i.g, n, item, list_sort(list_transform(list_filter(l, lambda x: abs(x.at - i.at) <= 300), lambda x: {'d': abs(x.at - i.at), 'r': -x.r, 'key': x.key}))[1].key AS pick FROM i LEFT JOIN t ON t.g = i.g WHERE n = 1)
  UNION ALL
  SELECT g, n, item, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (
    SELECT i.g, i.n, i.item, used, list_sort(list_transform(list_filter(l, lambda x: abs(x.at - i.at) <= 300 AND NOT list_contains(used, x.key)), lambda x: {'d': abs(x.at - i.at), 'r': -x.r, 'key': x.key}))[1].key AS pick
    FROM s JOIN i ON i.g = s.g AND i.n = s.n + 1 LEFT JOIN t ON t.g = i.g)
)
SELECT g, item, pick AS target FROM s
""")
def greedy_targets(t: Tables) -> DataFrame:
    """Items in order each take the nearest target that is free, within a tolerance; a group's targets and items are one task's work."""
    items = t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("at"))
    targets = t.supplier.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("target"), F.col("s_acctbal").alias("spot"))
    return joins.greedy_nearest(items, targets, "g", "item", "at", "target", "spot", 300.0)


@query("""
SELECT l_suppkey, mode_size, CAST(med AS DOUBLE) AS med FROM (
  SELECT l_suppkey, median(CAST(l_quantity AS DOUBLE)) AS med FROM lineitem GROUP BY 1) JOIN (
  SELECT l_suppkey, q AS mode_size FROM (SELECT l_suppkey, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, CAST(l_quantity AS INT) DESC) AS n FROM lineitem GROUP BY 1, 2) WHERE n = 1) USING (l_suppkey)
""")
def mode_and_median(t: Tables) -> DataFrame:
    """The mode (ties: the larger) and the exact median."""
    q = t.lineitem.select("l_suppkey", F.col("l_quantity").cast("int").alias("q"), F.col("l_quantity").cast("double").alias("x"))
    modes = windows.first_of(q.groupBy("l_suppkey", "q").agg(F.count("*").alias("n")), ["l_suppkey"], [F.desc("n"), F.desc("q")]).select("l_suppkey", F.col("q").alias("mode_size"))
    return q.groupBy("l_suppkey").agg(F.median("x").alias("med")).join(modes, "l_suppkey")


@query("""
WITH g AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS first, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, n FROM g ORDER BY first
""")
def ordered_groups(t: Tables) -> DataFrame:
    """Groups in order of their least key."""
    g = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"), F.count("*").alias("n"))
    return g.orderBy("first").select("c_nationkey", "c_mktsegment", "n")


@query("""
SELECT c_nationkey, CAST(n_rows AS BIGINT) AS n_rows, CAST(negative AS BIGINT) AS negative, CAST(far AS BIGINT) AS far, n_rows = negative AS all_negative FROM (
SELECT c_nationkey, count(*) AS n_rows, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (CAST(c_acctbal AS DECIMAL(12,2)) > 5000) AS far FROM customer GROUP BY 1)
""")
def quality_counts(t: Tables) -> DataFrame:
    """Several conditional counts in one pass, with derived flags."""
    g = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n_rows"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_if(_money("c_acctbal") > 5000).alias("far"))
    return g.withColumn("all_negative", F.col("n_rows") == F.col("negative"))
