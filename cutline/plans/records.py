"""Codes, keys, states, checklists and recommendations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions import columns as C
from cutline.operators import decisions as D
from cutline.operators import grid, ingest, joins, matching, records, vectors
from cutline.sources import writers

from .decisions import _CANDIDATES, _candidates
from .registry import Tables, query


@query("""
SELECT c_custkey, n_nationkey AS nation_id FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def code_to_id(t: Tables) -> DataFrame:
    """names of nations to their ids; an unknown one would be an error."""
    rows = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("code")), "c_nationkey")
    return records.resolve_codes(rows, "code", t.nation, "n_name", "n_nationkey", "nation_id").select("c_custkey", "nation_id")


@query("""
SELECT c_custkey, (SELECT CAST(max(o_orderdate) AS VARCHAR) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS last_filled FROM customer
""")
def last_filled(t: Tables) -> DataFrame:
    """A correlated maximum under a condition."""
    found = joins.max_of(t.customer, t.orders.where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "o_orderdate", "last")
    return found.select("c_custkey", F.col("last").cast("string").alias("last_filled"))


@query("""
SELECT d.doc_id, l.quality IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT 'db:documents/' || doc_id AS uri, quality FROM labels) l ON l.uri = 'db:documents/' || d.doc_id
""")
def synthesised_key(t: Tables) -> DataFrame:
    """A left join on a key that is put together from a prefix and an id."""
    uri = F.concat(F.lit("db:documents/"), F.col("doc_id").cast("string"))
    held = t.labels.select(uri.alias("uri"), "quality")
    return t.documents.select("doc_id", uri.alias("uri")).join(held, "uri", "left").select("doc_id", F.col("quality").isNotNull().alias("labelled"))


@query("""
SELECT p_partkey, CAST(coalesce(z, CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS price
FROM part LEFT JOIN (SELECT l_partkey, max(CAST(l_extendedprice AS DECIMAL(12,2))) AS z FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_partkey = p_partkey
""")
def override_prices(t: Tables) -> DataFrame:
    """Base values and those that take their place."""
    over = t.lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.col("l_extendedprice").cast("decimal(12,2)")).alias("z"))
    base = t.part.select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("base"))
    return joins.override_join(base, over, ["p_partkey"], "base", "z", "price").select("p_partkey", "price")


_PREFIXES = [("STANDARD", "s"), ("STANDARD AN", "sa"), ("STANDARD ANODIZED", "sao"), ("PROMO", "p"), ("PROMO B", "pb"), ("ECON", "e"), ("M", "m"), ("MEDIUM POLISHED", "mp")]


@query(f"""
WITH x AS (SELECT * FROM (VALUES {", ".join(map(str, _PREFIXES))}) v(prefix, mark)),
r AS (SELECT p_partkey, mark, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS n FROM part JOIN x ON starts_with(p_type, prefix))
SELECT p.p_partkey, r.mark FROM part p LEFT JOIN r ON r.p_partkey = p.p_partkey AND r.n = 1
""")
def longest_prefix(t: Tables) -> DataFrame:
    """The longest dictionary entry that a text begins with."""
    words = t.spark.createDataFrame(_PREFIXES, "prefix string, mark string")
    return records.longest_prefix(t.part.select("p_partkey", "p_type"), "p_type", words, "prefix", "mark").select("p_partkey", "mark")


@query("""
WITH k AS (SELECT p_partkey, CAST(p_partkey % 120 AS VARCHAR) AS k FROM part), x AS (SELECT lpad(CAST(i AS VARCHAR), 3, '0') AS k, 'tag' || i AS tag FROM range(0, 100) r(i))
SELECT p_partkey, coalesce(a.tag, b.tag) AS tag FROM k LEFT JOIN x a ON a.k = k.k LEFT JOIN x b ON b.k = lpad(k.k, 3, '0')
""")
def tags_by_padded_key(t: Tables) -> DataFrame:
    """Tags by key, or by the key filled up with zeros."""
    i = F.col("id").cast("string")
    tags = t.spark.range(100).select(F.lpad(i, 3, "0").alias("k"), F.concat(F.lit("tag"), i).alias("tag"))
    return records.by_key_or_padded(t.part.select("p_partkey", (F.col("p_partkey") % 120).cast("string").alias("key")), "key", tags, "k", "tag", 3).select("p_partkey", "tag")


@query("""
SELECT s_nationkey, s_suppkey, 'old' AS origin FROM supplier WHERE s_nationkey % 3 <> 0
UNION ALL SELECT s_nationkey, s_suppkey, 'new' FROM supplier WHERE s_nationkey % 3 = 0 AND s_suppkey % 2 = 0
""")
def replaced_sets(t: Tables) -> DataFrame:
    """DML: the set of each named owner is deleted and put in anew; owners may end with none."""
    old = t.supplier.select("s_nationkey", "s_suppkey", F.lit("old").alias("origin"))
    new = t.supplier.where("s_suppkey % 2 = 0").select("s_nationkey", "s_suppkey", F.lit("new").alias("origin"))
    owners = t.nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return records.replace_sets(old, new, "s_nationkey", owners)


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def deleted_keys(t: Tables) -> DataFrame:
    """DML: rows deleted by key."""
    gone = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.delete_keys(t.orders, gone, ["o_orderkey"]).select("o_orderkey")


@query("""
WITH held AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'sub' || s_suppkey END AS sub, lower(s_name) AS mail FROM supplier WHERE s_suppkey % 5 <> 0),
seen AS (SELECT s_suppkey AS n, 'sub' || s_suppkey AS sub, CASE WHEN s_suppkey % 3 <> 0 THEN lower(s_name) END AS mail FROM supplier)
SELECT n, coalesce((SELECT min(id) FROM held WHERE held.sub = seen.sub), (SELECT min(id) FROM held WHERE held.mail = seen.mail)) AS id FROM seen
""")
def identity_by_two_keys(t: Tables) -> DataFrame:
    """DML: who somebody is, by one key or else by another."""
    key, mail = F.concat(F.lit("sub"), F.col("s_suppkey").cast("string")), F.lower("s_name")
    held = t.supplier.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, key).alias("sub"), mail.alias("mail"))
    seen = t.supplier.select(F.col("s_suppkey").alias("n"), key.alias("sub"), F.when(F.col("s_suppkey") % 3 != 0, mail).alias("mail"))
    return records.identify(seen, held, "sub", "mail", "id").select("n", "id")


@query("""
WITH f AS (SELECT o_custkey, year(o_orderdate) AS y, max(CAST(o_totalprice AS DECIMAL(12,2))) AS z FROM orders GROUP BY 1, 2),
m AS (SELECT CASE WHEN o_custkey % 10 = 1 THEN o_custkey + 1 ELSE o_custkey END AS k, y, z, o_custkey % 10 = 1 AS moved, o_custkey FROM f)
SELECT k AS o_custkey, y, CAST(z AS DOUBLE) AS z FROM (SELECT *, row_number() OVER (PARTITION BY k, y ORDER BY moved, o_custkey) AS n FROM m) WHERE n = 1
""")
def merged_keys(t: Tables) -> DataFrame:
    """DML: codes renamed to others that may have rows of their own."""
    facts = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.max(F.col("o_totalprice").cast("decimal(12,2)")).alias("z"))
    renames = t.customer.where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    return records.merge_keys(facts, renames, "o_custkey", "old", "new", ["y"], "z")


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS code, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 7 = 0 THEN 'skipped' ELSE 'confirmed' END AS status FROM orders),
l AS (SELECT o_custkey, code, min(o_orderkey) AS least FROM c WHERE status = 'confirmed' AND code IS NOT NULL GROUP BY 1, 2),
g AS (SELECT o_custkey, count(*) FILTER (status = 'pending') AS pending FROM c GROUP BY 1)
SELECT o_orderkey, CASE WHEN pending > 0 THEN 'incomplete' WHEN status <> 'confirmed' OR c.code IS NULL THEN 'ignored' WHEN o_orderkey = least THEN 'representative' ELSE 'conflict' END AS outcome
FROM c JOIN g USING (o_custkey) LEFT JOIN l ON l.o_custkey = c.o_custkey AND l.code = c.code
""")
def confirmed_mapping(t: Tables) -> DataFrame:
    """Gates and representatives when the mapped columns of a run are confirmed."""
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderkey") % 7 == 0, "skipped").otherwise("confirmed")
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("code"), status.alias("status"))
    return records.confirm_columns(rows, "o_custkey", "o_orderkey", "code", "status").select("o_orderkey", "outcome")


@query("""
WITH n AS (SELECT s_name AS label, unnest(['balance', 'nation']) AS row, unnest([CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR), CAST(s_nationkey AS VARCHAR)]) AS value FROM supplier WHERE s_suppkey % 3 = 0),
o AS (SELECT s_name AS label, 'balance' AS row, 'stored' AS value FROM supplier)
SELECT label, row, value FROM n UNION ALL SELECT * FROM o WHERE (label, row) NOT IN (SELECT (label, row) FROM n)
""")
def codeless_columns(t: Tables) -> DataFrame:
    """The cells of columns without a code, put into the table by label."""
    cells = F.create_map(F.lit("balance"), F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.lit("nation"), F.col("s_nationkey").cast("string"))
    wide = t.supplier.select("s_name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")).alias("code"), cells.alias("cells"))
    old = t.supplier.select(F.col("s_name").alias("label"), F.lit("balance").alias("row"), F.lit("stored").alias("value"))
    return ingest.upsert(old, records.codeless(wide, "s_name", "code", "cells"), ["label", "row"])


@query("""
SELECT (SELECT count(*) FROM orders) AS n_rows, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS n_gaps, (SELECT max(year(o_orderdate)) FROM orders) AS default_year,
  (SELECT count(*) FROM part WHERE p_size > 25) AS n_added, (SELECT count(*) FROM part WHERE p_size > 25 AND p_retailprice > 1200) AS n_ready
""")
def promote_checklist(t: Tables) -> DataFrame:
    """What a run holds before it is promoted, as one row."""
    facts = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("z"), F.year("o_orderdate").cast("long").alias("y"))
    return records.promote_checklist(facts, "z", "y", t.part.where("p_size > 25"), F.col("p_retailprice") > 1200)


@query("""
SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'P') AS n_P, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'F') AS n_F,
  CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'P' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'O' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'F' END AS default_tab
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def tab_groups(t: Tables) -> DataFrame:
    """Counts by tab and the first tab that has any."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return records.tab_groups(rows, ["c_nationkey"], "o_orderstatus", ["P", "O", "F"])


@query("""
WITH r AS (SELECT event_id, (['running', 'needs_pages', 'needs_mapping', 'failed', 'success', 'partial'])[event_id % 6 + 1] AS s, (['success', 'running', 'failed', 'needs_mapping', 'partial'])[event_id % 5 + 1] AS w FROM events)
SELECT event_id, CASE WHEN w = 'running' AND s IN ('needs_pages', 'needs_mapping', 'failed') THEN 'running' WHEN s = 'running' AND w IN ('needs_mapping', 'failed', 'success', 'partial') THEN w
  WHEN s IN ('needs_pages', 'needs_mapping') AND w = 'failed' THEN w WHEN s = 'needs_mapping' AND w = 'success' THEN w ELSE s END AS state FROM r
""")
def run_states(t: Tables) -> DataFrame:
    """The states of runs and what they may go on to."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int") + 1)
    state, wanted = pick(["running", "needs_pages", "needs_mapping", "failed", "success", "partial"]), pick(["success", "running", "failed", "needs_mapping", "partial"])
    return t.events.select("event_id", records.next_state(state, wanted).alias("state"))


@query("""
SELECT * FROM (
  SELECT conv_id, 'content' AS kind, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS said FROM conversations GROUP BY conv_id
  UNION ALL SELECT conv_id, 'latest', role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations) WHERE n = 1
) ORDER BY 1, 2 LIMIT 60
""")
def course_lookup(t: Tables) -> DataFrame:
    """Ordered text and latest value of each key, beneath each other, ordered by position and cut."""
    return records.lookup(t.conversations, "conv_id", ["turn", "role"], "text", t.conversations, "turn", "role")


@query("""
SELECT p_partkey, CAST((p_size > 40)::INT + (p_retailprice < 1000)::INT + (contains(p_name, 'a'))::INT AS BIGINT) AS n_blockers FROM part ORDER BY n_blockers DESC, p_partkey LIMIT 50
""")
def most_broken_first(t: Tables) -> DataFrame:
    """A report of what has the most to mend, first."""
    blockers = F.array_compact(F.array(F.when(F.col("p_size") > 40, "size"), F.when(F.col("p_retailprice") < 1000, "price"), F.when(F.col("p_name").contains("a"), "name")))
    return t.part.select("p_partkey", F.size(blockers).cast("long").alias("n_blockers")).orderBy(F.desc("n_blockers"), "p_partkey").limit(50)


@query("""
SELECT source, count(*) FILTER (l.quality IS NOT NULL) AS have, count(*) FILTER (l.quality IS NULL) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source
""")
def gap_report(t: Tables) -> DataFrame:
    """How many have what is asked for and how many lack it."""
    return records.have_and_missing(t.documents.join(t.labels, "doc_id", "left"), "source", F.col("quality").isNotNull())


@query(r"""
SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), '\b(brass|tin)') THEN 'soft' WHEN regexp_matches(lower(p_type), '\b(steel|promo)') THEN 'hard' ELSE 'other' END AS topic FROM part
""")
def topic_routes(t: Tables) -> DataFrame:
    """The first topic that a text holds a word of."""
    return t.part.select("p_partkey", records.route(F.col("p_type"), {"soft": ["brass", "tin"], "hard": ["steel", "promo"]}, "other").alias("topic"))


@query(r"""
SELECT doc_id, length(regexp_replace(coalesce(text, '') || chr(57345) || chr(7), '[\p{Cc}\p{Co}]', '', 'g')) AS n FROM documents
""")
def printable_only(t: Tables) -> DataFrame:
    """2.9: control and private-use characters taken out."""
    odd = F.concat(F.coalesce("text", F.lit("")), F.lit(chr(57345)), F.lit(chr(7)))
    return t.documents.select("doc_id", F.length(C.printable(odd)).cast("long").alias("n"))


@query("""
SELECT s_suppkey, CAST(CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS VARCHAR) AS shown FROM supplier
""")
def four_places(t: Tables) -> DataFrame:
    """2.9: numbers written with four places."""
    return t.supplier.select("s_suppkey", C.four_places(F.col("s_acctbal").cast("decimal(12,2)")).alias("shown"))


@query("""
SELECT x, count(*) AS n FROM (SELECT unnest(CASE WHEN event_id % 2 = 0 THEN [event_type, 'u' || (user_id % 5)] ELSE [] END) AS x FROM events) GROUP BY x
""")
def json_array_unnest(t: Tables) -> DataFrame:
    """JSON arrays unnested; what isn't an array gives no row."""
    raw = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(F.col("event_type"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))))).otherwise(F.col("props"))
    return t.events.select(F.explode(C.json_array(raw)).alias("x")).groupBy("x").agg(F.count("*").alias("n"))


_CONFIG = D.Scoring({"z_margin": 0.4, "interest": 0.35, "university": 0.25})


@query(f"""
WITH {_CANDIDATES},
j AS (SELECT o_orderkey, c_nationkey, CAST(cutoff AS DOUBLE) AS cutoff, CAST(120000 - cutoff AS DOUBLE) / 100000 AS margin FROM cand WHERE y = 1998 AND cutoff <= 120000),
s AS (SELECT *, (tanh(margin * 4) + 1) / 2 AS z_margin, greatest(0.0, least(1.0, ((o_orderkey % 101) / 100.0 - 0.45) / (1 - 0.45))) AS interest,
  CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN c_nationkey IN (3, 7) THEN 1.0 WHEN n_regionkey = 1 THEN 0.5 ELSE 0.2 END END AS university FROM j JOIN nation ON n_nationkey = c_nationkey),
a AS (SELECT *, CASE WHEN university IS NULL THEN 0.75 ELSE 1.0 END AS active FROM s),
w AS (SELECT *, round_even(round_even(CAST(0.4 / active * z_margin AS DOUBLE), 4) + round_even(CAST(0.35 / active * interest AS DOUBLE), 4) + coalesce(round_even(CAST(0.25 / active * university AS DOUBLE), 4), 0), 4) AS total FROM a),
r AS (SELECT *, row_number() OVER (ORDER BY total DESC, o_orderkey) AS place, count(*) OVER () AS n_all FROM w)
SELECT o_orderkey, place, CAST(round(total * 10000) AS BIGINT) AS total, CASE WHEN total >= 0.6 AND margin >= 0.10 THEN 'safe' ELSE 'consider' END AS bucket, n_all FROM r WHERE place <= 50
""")
def recommendation(t: Tables) -> DataFrame:
    """Candidates scored by margin, interest and place, put in buckets and in order; the first 50 and how many there are."""
    rows = _candidates(t, 1998).join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    margin = (F.lit(120000).cast("decimal(12,2)") - F.col("cutoff")).cast("double") / 100000
    judged = rows.withColumns({"margin": margin, "passes": F.lit(True), "status": F.when(margin < 0, "near_miss").otherwise("eligible"), "profile": F.lit(1)})
    preferred = F.when(F.col("o_orderkey") % 4 != 0, F.array(F.lit(3), F.lit(7)))
    dimensions = [
        ("z_margin", lambda: D.margin_score(F.col("margin"))),
        ("interest", lambda: D.similarity_score((F.col("o_orderkey") % 101) / 100.0)),
        ("university", lambda: D.place_score(F.col("c_nationkey"), F.col("n_regionkey"), preferred, F.lit(1))),
    ]
    placed = D.recommend(judged, dimensions, _CONFIG, ["profile"], F.lit(True), "cutoff", "o_orderkey").where("place <= 50")
    return placed.join(F.broadcast(judged.where("status <> 'near_miss'").agg(F.count("*").alias("n_all")))).select(
        "o_orderkey", F.col("place").cast("long").alias("place"), F.round(F.col("total") * 10000, 0).cast("long").alias("total"), "bucket", "n_all"
    )


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS tag, strftime(o_orderdate, '%B %d, %Y') AS said, regexp_replace(o_orderkey || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN 'x1' ELSE '' END, '[A-Za-z]+$', '') AS number,
  CASE WHEN o_orderkey % 5 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 1 END AS w_a, CASE WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN NULL ELSE 2 END AS w_b FROM orders
""")
def scalar_forms(t: Tables) -> DataFrame:
    """2.9-5, 2.9-19, 2.9-21: tags of moments, long dates, codes without their letters, maps filled up with defaults."""
    k = F.col("o_orderkey")
    given = F.when(k % 5 == 0, F.lit(None).cast("map<string,bigint>")).when(k % 3 == 0, F.create_map(F.lit("a"), F.col("o_custkey"))).when(k % 3 == 1, F.create_map(F.lit("b"), F.lit(None).cast("long"))).otherwise(F.create_map().cast("map<string,bigint>"))
    whole = C.with_defaults(given, F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.lit(2).cast("long")))
    code = F.concat(k.cast("string"), "o_orderstatus", F.when(k % 2 == 0, "x1").otherwise(""))
    return t.orders.select("o_orderkey", C.utc_tag(F.col("o_orderdate")).alias("tag"), C.long_date(F.col("o_orderdate")).alias("said"), C.number_part(code).alias("number"), whole["a"].alias("w_a"), whole["b"].alias("w_b"))


_CODE_WORDS = "list_distinct(list_transform(list_filter(regexp_extract_all(upper({}), '[A-Z0-9]+'), lambda w: w NOT IN ('OF', 'THE', 'AND', 'SRI', 'LANKA', 'UNIVERSITY', 'A', 'B')), lambda w: CASE w WHEN 'BIO' THEN 'BIOLOGICAL' WHEN 'SC' THEN 'SCIENCE' WHEN 'PHY' THEN 'PHYSICAL' WHEN 'TECH' THEN 'TECHNOLOGY' ELSE w END))"


@query(f"""
WITH c AS (SELECT p_brand AS code, {_CODE_WORDS.format("max(p_type) || ' of Bio'")} AS words FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1),
h AS (SELECT p_size AS page, {_CODE_WORDS.format("'THE ' || p_type || ' Biological'")} AS said FROM part WHERE p_partkey % 3 = 0),
k AS (SELECT DISTINCT p_size AS page, p_brand AS code FROM part WHERE p_partkey % 4 = 0)
SELECT page, code, CASE WHEN words IS NULL THEN 'unknown' ELSE 'unsupported' END AS reason FROM k LEFT JOIN c USING (code)
WHERE words IS NULL OR NOT EXISTS (SELECT 1 FROM h WHERE h.page = k.page AND list_has_all(said, words))
""")
def verified_codes(t: Tables) -> DataFrame:
    """Printed codes whose name no header of the page holds, without noise words and with abbreviations spelled out."""
    names = t.part.where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("code")).agg(F.concat(F.max("p_type"), F.lit(" of Bio")).alias("name"))
    headers = t.part.where("p_partkey % 3 = 0").select(F.col("p_size").alias("page"), F.concat(F.lit("THE "), "p_type", F.lit(" Biological")).alias("text"))
    return matching.verify_codes(t.part.where("p_partkey % 4 = 0").select(F.col("p_size").alias("page"), F.col("p_brand").alias("code")), names, headers)


_ASKING = [(1, 60000, 3, 1998, None, None), (2, 90000, 5, 1997, [5, 7], None), (3, 120000, 11, 1998, None, 20), (4, 80000, 3, 1996, [3], 40), (5, 100, 3, 1996, [], None)]
_NONE = "NULL"
_ASKING_SQL = ", ".join(f"({i}, {z}, {n}, {y}, {_NONE if p is None else f'{p}::INT[]'}, {v or _NONE})" for i, z, n, y, p, v in _ASKING)
_COSINE = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"


@query(f"""
WITH p AS (SELECT * FROM (VALUES {_ASKING_SQL}) v(profile_id, z, place, y, preferred, vec)),
ov AS (SELECT l_orderkey, max(CAST(l_extendedprice AS DECIMAL(12,2))) AS z FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
c AS (SELECT o_orderkey, year(o_orderdate) AS y, c_nationkey, o_custkey % 25 AS uni, coalesce(ov.z, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) END) AS cutoff
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN ov ON l_orderkey = o_orderkey WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_linestatus = 'O')),
i AS (SELECT q.vec_id AS vec, e.label, max({_COSINE}) AS best FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT vec FROM p) GROUP BY 1, 2),
j AS (SELECT profile_id, preferred, p.vec, o_orderkey, uni, CAST(cutoff AS DOUBLE) AS cutoff, CAST(p.z - cutoff AS DOUBLE) / 100000 AS margin FROM c JOIN p ON c.y = p.y AND c_nationkey = place WHERE cutoff <= p.z),
s AS (SELECT j.*, (tanh(margin * 4) + 1) / 2 AS z_margin, CASE WHEN best IS NOT NULL THEN greatest(0.0, least(1.0, (best - 0.45) / (1 - 0.45))) END AS interest,
  CASE WHEN len(preferred) > 0 THEN CASE WHEN list_contains(preferred, uni) THEN 1.0 WHEN n_regionkey = 1 THEN 0.5 ELSE 0.2 END END AS university,
  CASE WHEN coalesce(len(preferred), 0) > 0 OR j.vec IS NOT NULL THEN 'preference' ELSE 'normal' END AS mode
  FROM j JOIN nation ON n_nationkey = uni LEFT JOIN i ON i.vec = j.vec AND i.label = o_orderkey % 10),
a AS (SELECT *, 0.4 + CASE WHEN interest IS NULL THEN 0 ELSE 0.35 END + CASE WHEN university IS NULL THEN 0 ELSE 0.25 END AS active FROM s),
w AS (SELECT *, round_even(round_even(CAST(0.4 / active * z_margin AS DOUBLE), 4) + coalesce(round_even(CAST(0.35 / active * interest AS DOUBLE), 4), 0) + coalesce(round_even(CAST(0.25 / active * university AS DOUBLE), 4), 0), 4) AS total FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY CASE WHEN mode = 'preference' THEN total ELSE cutoff END DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY profile_id) AS n_all FROM w),
o AS (SELECT profile_id, o_orderkey, row_number() OVER (PARTITION BY profile_id ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY profile_id) AS n_all FROM c JOIN p ON c.y = p.y AND c_nationkey = p.place WHERE cutoff IS NULL)
SELECT profile_id, 'recommended' AS kind, mode, place, o_orderkey, CAST(round(total * 10000) AS BIGINT) AS total, CASE WHEN total >= 0.6 AND margin >= 0.10 THEN 'safe' ELSE 'consider' END AS bucket, n_all FROM r WHERE place <= 50
UNION ALL SELECT profile_id, 'also_offered', NULL, place, o_orderkey, NULL, NULL, n_all FROM o WHERE place <= 50
""")
def recommendations(t: Tables) -> DataFrame:
    """Many profiles at once: interest from the nearest chunk of each group, lists by score or by cutoff, and what is offered without a cutoff."""
    profiles = t.spark.createDataFrame(_ASKING, "profile_id int, z int, place int, y int, preferred array<int>, vec long")
    asked = profiles.select("y", F.col("place").alias("c_nationkey"))
    held = _candidates(t, among=asked).drop("cutoff")
    facts = t.orders.select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("uni"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice").cast("decimal(12,2)")).alias("base"))
    over = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast("decimal(12,2)").alias("o")).join(held.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.max("o").alias("o"))
    cand = joins.override_join(held.join(facts, "o_orderkey"), over, ["o_orderkey"], "base", "o", "cutoff")
    rows = cand.join(profiles.withColumnRenamed("place", "c_nationkey"), ["y", "c_nationkey"])
    interest = vectors.best_of_groups(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), t.embeddings.join(profiles.select(F.col("vec").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding"), "label")
    interest = interest.select(F.col("query_id").alias("vec"), F.col("label").cast("long").alias("topic"), "similarity")
    rows = rows.withColumn("topic", F.col("o_orderkey") % 10).join(interest, ["vec", "topic"], "left").join(t.nation.select(F.col("n_nationkey").alias("uni"), "n_regionkey"), "uni")
    margin = (F.col("z").cast("decimal(12,2)") - F.col("cutoff")).cast("double") / 100000
    judged = rows.where("cutoff IS NOT NULL").withColumns({"margin": margin, "passes": F.lit(True), "status": F.when(margin < 0, "near_miss").otherwise("eligible")})
    dimensions = [
        ("z_margin", lambda: D.margin_score(F.col("margin"))),
        ("interest", lambda: F.when(F.col("similarity").isNotNull(), D.similarity_score(F.col("similarity")))),
        ("university", lambda: D.place_score(F.col("uni"), F.col("n_regionkey"), F.col("preferred"), F.lit(1))),
    ]
    stated = (F.coalesce(F.size("preferred"), F.lit(0)) > 0) | F.col("vec").isNotNull()
    best = D.recommend_profiles(judged, "profile_id", dimensions, _CONFIG, stated, "cutoff", "o_orderkey")
    also = D.also_offered(rows.select("profile_id", "o_orderkey"), rows.where("cutoff IS NOT NULL").select("o_orderkey"), ["o_orderkey"], "profile_id", "o_orderkey")
    total = F.round(F.col("total") * 10000, 0).cast("long").alias("total")
    first = best.select("profile_id", F.lit("recommended").alias("kind"), "mode", F.col("place").cast("long").alias("place"), "o_orderkey", total, "bucket", "n_all")
    return first.unionByName(also.select("profile_id", F.lit("also_offered").alias("kind"), F.col("place").cast("long").alias("place"), "o_orderkey", "n_all"), allowMissingColumns=True)


@query("""
WITH gaps AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998)),
added AS (SELECT p_partkey AS k, p_retailprice > 1200 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linestatus = 'O') AND EXISTS (SELECT 1 FROM documents WHERE doc_id = p_partkey) AS ready FROM part WHERE p_size > 25)
SELECT 1998 AS promoted_year, (SELECT max(year(o_orderdate)) FROM orders) AS students_now_see, (SELECT max(year(o_orderdate)) FROM orders) = 1998 AS is_default_year,
  (SELECT count(*) FROM gaps) AS coverage_gap_count, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM gaps ORDER BY k LIMIT 15)) AS coverage_gaps,
  (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A' AND year(l_shipdate) = 1998) AS stream_override_rows, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1998) AS codeless_rows,
  (SELECT count(*) FROM added) AS new_total, (SELECT count(*) FROM added WHERE ready) AS new_onboarded, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM added WHERE NOT ready ORDER BY k LIMIT 15)) AS new_pending
""")
def promoted_year(t: Tables) -> DataFrame:
    """The card of a promoted year: default or not, missing keys, overrides, codeless rows, and which new keys are ready."""
    active = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("k"))
    facts = t.orders.select(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("k"))
    overrides = t.lineitem.where(C.in_year("l_shipdate", 1998) & (F.col("l_returnflag") == "A")).select(F.lit(1998).alias("year"))
    codeless = t.orders.where("o_orderstatus = 'P'").select(F.year("o_orderdate").alias("year"))
    added = t.part.where("p_size > 25").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") > 1200).alias("is_active"))
    added = joins.exists_flag(added, t.lineitem.where("l_linestatus = 'O'").select(F.col("l_partkey").alias("k")), ["k"], "has_streams")
    added = joins.exists_flag(added, t.documents.select(F.col("doc_id").alias("k")), ["k"], "has_sheet")
    card = records.promote_card(1998, active, "k", facts, overrides, codeless, added, F.col("is_active") & F.col("has_streams") & F.col("has_sheet"))
    listed = lambda c: F.array_join(F.transform(c, lambda k: k.cast("string")), ",").alias(c)
    return card.select(*(listed(c) if c in ("coverage_gaps", "new_pending") else c for c in card.columns))


_LABEL = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' #* & (New) - A' WHEN 1 THEN ' (Alpha (Beta))' WHEN 2 THEN '  ' ELSE ' - B' END"


@query(rf"""
SELECT p_partkey, trim(regexp_replace(replace(regexp_replace(upper(x), '[#*]', ' ', 'g'), '&', ' AND '), '\s+', ' ', 'g')) AS normal,
  array_to_string(list_sort(list_distinct(regexp_extract_all(replace(upper(x), '&', ' AND '), '[A-Z0-9]+'))), ' ') AS tokens, regexp_replace(x, '\s*-\s*[A-Z]\b', ' ', 'g') AS plain,
  trim(regexp_replace(regexp_replace(x, '\([^()]*\)', ' ', 'g'), '\s+', ' ', 'g')) AS bare, CASE WHEN p_partkey % 4 = 1 THEN 'Alpha (Beta)' END AS inside
FROM (SELECT p_partkey, {_LABEL} AS x FROM part)
""")
def label_forms(t: Tables) -> DataFrame:
    """2.9: labels normalised, as tokens, without track and parentheses, and their last parenthetical."""
    x = F.expr(_LABEL)
    return t.part.select("p_partkey", x.alias("x")).select(
        "p_partkey", C.normal_label(F.col("x")).alias("normal"), F.array_join(F.array_sort(C.label_tokens(F.col("x"))), " ").alias("tokens"), C.without_variant(F.col("x")).alias("plain"),
        C.without_parentheses(F.col("x")).alias("bare"), C.last_parenthetical(F.col("x"))["inner"].alias("inside"),
    )


@query("""
SELECT o_orderkey, 'Order ' || o_orderkey || ' of ' || o_custkey || ': ' || o_orderstatus || '{{other}}' AS said,
  array_to_string(list_sort(list_distinct(list_concat(range(o_orderkey % 5, o_orderkey % 5 + 4), [9, o_orderkey % 7]))), ',') AS pages FROM orders
""")
def rendered(t: Tables) -> DataFrame:
    """2.9: a template filled in, and page specifications spelled out."""
    said = C.template(F.lit("Order {{key}} of {{cust}}: {{status}}{{other}}"), {"key": F.col("o_orderkey"), "cust": F.col("o_custkey"), "status": F.col("o_orderstatus")})
    low = F.col("o_orderkey") % 5
    spec = F.concat_ws("", low.cast("string"), F.lit("-"), (low + 3).cast("string"), F.lit(", 9,"), (F.col("o_orderkey") % 7).cast("string"))
    return t.orders.select("o_orderkey", said.alias("said"), F.array_join(F.transform(C.page_numbers(spec), lambda p: p.cast("string")), ",").alias("pages"))


@query("""
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'nowhere' ELSE '  ' || replace(lower(n_name), ' ', '   ') END AS row, 'L' || (o_orderkey % 7) AS label,
  CASE o_orderkey % 6 WHEN 0 THEN 'nqc' WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN '12.409' WHEN 4 THEN '-' ELSE '1.' || (o_orderkey % 10000) END AS raw, n_nationkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
j AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'UNKNOWN_ROW' WHEN o_orderkey % 7 > 4 THEN 'UNKNOWN_LABEL' WHEN raw = 'nqc' THEN NULL WHEN raw IN ('', '-') THEN 'MISSING' WHEN TRY_CAST(raw AS DECIMAL(12,4)) IS NULL THEN 'UNPARSEABLE' WHEN TRY_CAST(raw AS DECIMAL(12,4)) NOT BETWEEN -2 AND 4 THEN 'OUT_OF_RANGE' END AS problem FROM c)
SELECT coalesce(problem, 'C' || (o_orderkey % 7)) AS what, CASE WHEN problem IS NULL THEN n_nationkey END AS row_id, count(*) AS n, count(*) FILTER (problem IS NULL AND raw = 'nqc') AS notes,
  CAST(coalesce(sum(CASE WHEN problem IS NULL AND raw <> 'nqc' THEN CAST(raw AS DECIMAL(12,4)) END), 0) AS DOUBLE) AS total FROM j GROUP BY 1, 2
""")
def resolved_cells(t: Tables) -> DataFrame:
    """Good rows and error rows of a wide text table's cells, by code and problem."""
    m = F.col("o_orderkey") % 6
    raw = F.when(m == 0, "nqc").when(m == 1, "").when(m == 2, "abc").when(m == 3, "12.409").when(m == 4, "-").otherwise(F.concat(F.lit("1."), (F.col("o_orderkey") % 10000).cast("string")))
    row = F.when(F.col("o_orderkey") % 10 == 0, "nowhere").otherwise(F.concat(F.lit("  "), F.replace(F.lower("n_name"), F.lit(" "), F.lit("   "))))
    placed = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    cells = placed.select(F.lit(2024).alias("period"), row.alias("row"), F.concat(F.lit("L"), (F.col("o_orderkey") % 7).cast("string")).alias("label"), raw.alias("raw"))
    rows = t.nation.select(F.replace("n_name", F.lit(" "), F.lit("_")).alias("row_code"), F.col("n_nationkey").alias("row_id"))
    i = F.col("id").cast("string")
    good, bad = ingest.resolve_cells(cells, rows, t.spark.range(5).select(F.concat(F.lit("L"), i).alias("label"), F.concat(F.lit("C"), i).alias("code")))
    total = F.coalesce(F.sum(F.col("value").cast("decimal(18,4)")), F.lit(0)).cast("double")
    counted = good.groupBy(F.col("code").alias("what"), "row_id").agg(F.count("*").alias("n"), F.count("note").alias("notes"), total.alias("total"))
    wrong = bad.groupBy(F.col("problem").alias("what")).agg(F.count("*").alias("n")).select("what", F.lit(None).cast("int").alias("row_id"), "n", F.lit(0).cast("long").alias("notes"), F.lit(0.0).alias("total"))
    return counted.unionByName(wrong)


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 1 WHEN doc_id % 3 = 0 THEN 4 ELSE 3 END AS version FROM documents
""")
def bumped_versions(t: Tables) -> DataFrame:
    """DML: the version goes up where the content's hash has changed; new keys begin at 1."""
    old = t.documents.where("doc_id % 2 = 0").select("doc_id", F.col("text").alias("content"), F.lit(3).alias("version"))
    new = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("content"))
    return ingest.version_bump(old, new, "doc_id").select("doc_id", "version")


@query("""
SELECT n_nationkey, n_nationkey = 5 AS is_active FROM nation
""")
def activated(t: Tables) -> DataFrame:
    """DML: one row of a table made the active one."""
    return ingest.exclusive_activation(t.nation.select("n_nationkey", F.lit(True).alias("is_active")), "n_nationkey", 5).select("n_nationkey", "is_active")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 < 2 AND p_partkey % 3 <> 0 THEN 'confirmed' WHEN p_partkey % 5 = 0 THEN 'skipped' ELSE 'pending' END AS status FROM part
""")
def confirmed_in_bulk(t: Tables) -> DataFrame:
    """Pending suggestions that are sure and known become confirmed."""
    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", F.when(k % 3 != 0, F.concat(F.lit("k"), (k % 3).cast("string"))).otherwise("other").alias("suggested"), F.when(k % 4 < 2, 0.999).otherwise(0.9).alias("confidence"), F.when(k % 5 == 0, "skipped").otherwise("pending").alias("status"))
    known = t.spark.createDataFrame([("k1",), ("k2",), ("k2",)], "code string")
    return ingest.bulk_confirm(rows, known, "p_partkey", "code").select("p_partkey", "status")


@query("""
SELECT p_partkey, p_brand || ' | ' || CASE WHEN p_brand IN ('Brand#11', 'Brand#22') THEN '(NOT IN SEED)' ELSE lower(p_brand) END AS header FROM part
""")
def relabelled_headers(t: Tables) -> DataFrame:
    """Codes with their names beside them, unknown ones marked."""
    names = t.part.where("p_brand NOT IN ('Brand#11', 'Brand#22')").select("p_brand", F.lower("p_brand").alias("name")).distinct()
    return writers.relabelled(t.part.select("p_partkey", "p_brand"), names, "p_brand", "name").select("p_partkey", "header")


@query("""
WITH i AS (SELECT p_type, p_brand, CAST(p_size AS VARCHAR) AS size, min(p_partkey) AS p_partkey, count(*) - 1 AS repeats FROM part GROUP BY 1, 2, 3)
SELECT p_partkey, p_type, repeats, count(*) OVER (PARTITION BY p_type) > 1 AS conflict FROM i
""")
def consolidated(t: Tables) -> DataFrame:
    """Columns that repeat in label and values become one; labels that stand over different values are conflicts."""
    values = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    kept, conflicts = grid.consolidate(t.part.select("p_partkey", "p_type", values.alias("values")), "p_type", "values", "p_partkey")
    flagged = joins.exists_flag(kept, conflicts, ["p_type"], "conflict")
    return flagged.select("p_partkey", "p_type", F.size("repeats").cast("long").alias("repeats"), "conflict")
