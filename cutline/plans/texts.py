"""Retrieval, matching, ingest and admission over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.functions import columns as C
from cutline.operators import fulltext, ingest, joins, matching, presence, retrieval, vectors, windows
from cutline.streaming import admission

from .registry import Tables, query


def _chunks(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))) AS similarity FROM embeddings, q)
SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s) WHERE rank <= 10
""")
def cosine_topk(t: Tables) -> DataFrame:
    """The nearest of all rows for each row whose id is divisible by 20."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.nearest(_chunks(t), q, 10).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query()
def vector_index(t: Tables) -> DataFrame:
    """The nearest of all rows for each row whose id is divisible by 20, through the index; its recall is measured in the tests."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.search(vectors.build_index(_chunks(t)), q, 10)
    return found.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, label, CAST(round(max(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])))) * 1000000) AS BIGINT) AS best FROM embeddings, q GROUP BY query_id, label
""")
def best_per_group(t: Tables) -> DataFrame:
    """The best similarity of each group to each query (row 0, or any row whose id is divisible by 20), in millionths."""
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    grouped = vectors.best_of_groups(_chunks(t), queries, "label")
    return grouped.select("query_id", "label", F.round(F.col("similarity") * 1000000, 0).cast("long").alias("best"))


@query("""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))) DESC, vec_id) AS rank FROM embeddings, q),
w AS (SELECT doc_id AS id, list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','to','was','with')), lambda x: CASE WHEN length(x) > 5 THEN regexp_replace(x, '(ing|ed|es|s)$', '') ELSE x END) AS w FROM documents),
k AS (SELECT id, row_number() OVER (ORDER BY ln(1 + len(list_filter(w, lambda x: x = 'er'))) + ln(1 + len(list_filter(w, lambda x: x = 'th'))) DESC, id) AS rank FROM w WHERE list_contains(w, 'er') AND list_contains(w, 'th')),
f AS (SELECT coalesce(v.id, k.id) AS id, v.rank AS a, k.rank AS b, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0) AS rrf FROM (SELECT * FROM v WHERE rank <= 20) v FULL JOIN (SELECT * FROM k WHERE rank <= 20) k ON v.id = k.id)
SELECT id, row_number() OVER (ORDER BY round(rrf, 12) DESC, a NULLS LAST, b NULLS LAST, id) AS place FROM f ORDER BY place LIMIT 5
""")
def rrf_hybrid(t: Tables) -> DataFrame:
    """Vector and keyword lists fused by reciprocal rank."""
    q = t.embeddings.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    v = vectors.nearest(_chunks(t), q, 20).select(F.col("chunk_id").alias("id"), "rank")
    k = retrieval.keyword_hits(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), ["er", "th"], 20, "id")
    return retrieval.fuse(v, k, "id").select("id", F.col("place").cast("long").alias("place"))


def _asked(t: Tables) -> DataFrame:
    """Every document whose id is divisible by 20 asks for its first words."""
    first = F.array_join(F.slice(F.split("text", r"\s+"), 1, 4), " ")
    return t.documents.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), first.alias("said"))


@query()
def fulltext_ranked(t: Tables) -> DataFrame:
    """2.9-18: stemmed words in stored postings, ranked by how close they stand, for all documents; held against a plain version in the tests."""
    postings = fulltext.build_postings(t.documents.select("doc_id", "text"), "doc_id", [("text", "D")])
    found = fulltext.search(postings, _asked(t), "query_id", "said", 10)
    return found.select("query_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def hybrid_retrieval(t: Tables) -> DataFrame:
    """For each id divisible by 20 the vectors near its own and the texts that hold its first words, fused by reciprocal rank."""
    postings = fulltext.build_postings(t.documents.select(F.col("doc_id").alias("id"), "text"), "id", [("text", "D")])
    words = fulltext.search(postings, _asked(t), "query_id", "said", 20)
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = vectors.search(vectors.build_index(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id"), q, 20)
    return retrieval.fuse_each(near, words, "query_id", "id").select("query_id", "id", F.round("rrf", 9).alias("rrf"), F.col("place").cast("long").alias("place"))


_TRIM = r"regexp_replace({}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


@query(rf"""
WITH RECURSIVE sec AS (SELECT doc_id, CAST(j AS BIGINT) AS j, x AS s FROM (
  SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '
## ', chr(1) || '## ', 'g'), chr(1)) AS l FROM documents))),
t AS (SELECT doc_id, j, {_TRIM.format("s")} AS s FROM sec),
b AS (SELECT doc_id, j, CASE WHEN starts_with(s, '## ') THEN trim(regexp_extract(s, '^## ([^
]*)', 1)) END AS heading, CASE WHEN starts_with(s, '## ') THEN {_TRIM.format("regexp_replace(s, '^[^\n]*\n?', '')")} ELSE s END AS body FROM t WHERE s <> ''),
q AS (SELECT doc_id, j, heading, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id, j, heading, CASE WHEN length(body) <= 2000 THEN [body] ELSE list_filter(list_transform(string_split_regex(body, '

+'), lambda x: {_TRIM.format("x")}), lambda x: x <> '') END AS l FROM b WHERE body <> '')),
c AS (
  SELECT doc_id, j, heading, i, p AS cur, 0 AS k FROM q WHERE i = 1
  UNION ALL SELECT q.doc_id, q.j, q.heading, q.i, CASE WHEN length(cur) + length(p) + 2 <= 2000 THEN cur || chr(10) || chr(10) || p ELSE p END, k + CASE WHEN length(cur) + length(p) + 2 <= 2000 THEN 0 ELSE 1 END
  FROM c JOIN q ON q.doc_id = c.doc_id AND q.j = c.j AND q.i = c.i + 1
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY j, k) - 1 AS INT) AS idx, heading, content FROM (SELECT doc_id, j, k, any_value(heading) AS heading, arg_max(cur, i) AS content FROM c GROUP BY doc_id, j, k)
""")
def chunk_markdown(t: Tables) -> DataFrame:
    """Sections packed by paragraph; line feeds stand for paragraphs here."""
    docs = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return retrieval.chunks(docs, "doc_id", "text", 2000)


@query("""
SELECT doc_id, CASE WHEN coalesce(old, '') = sha256(text) THEN 'kept' ELSE 'cut' END AS state FROM (SELECT d.doc_id, d.text, CASE WHEN l.quality = 1 THEN sha256(d.text) END AS old FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
""")
def incremental_reindex(t: Tables) -> DataFrame:
    """Chunks of unchanged documents are kept, others are cut anew."""
    d = t.documents.select("doc_id", "text")
    old = d.join(t.labels.where("quality = 1").select("doc_id"), "doc_id").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit(0).alias("idx"), F.lit("old").alias("heading"), F.col("text").alias("content"), F.lit(1).cast("long").alias("tokens"))
    now = retrieval.reindex(old, d, "doc_id", "text")
    state = F.when(F.max(F.coalesce(F.col("heading"), F.lit(""))) == "old", "kept").otherwise("cut")
    return now.groupBy("doc_id").agg(state.alias("state"))


_TAGS = [("die", ["de"]), ("queeaux", ["fr"]), ("the", ["en", "latin"]), ("ción", ["es", "latin"]), ("ing", ["en"])]


@query(r"""
SELECT doc_id, concat_ws(',', CASE WHEN h1 THEN 'de' END, CASE WHEN h3 OR h5 THEN 'en' END, CASE WHEN h4 THEN 'es' END, CASE WHEN h2 THEN 'fr' END, CASE WHEN h3 OR h4 THEN 'latin' END) AS tags
FROM (SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])die([^\p{L}\p{N}_]|$)') AS h1, contains(lower(text), 'queeaux') AS h2, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)') AS h3, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])ción([^\p{L}\p{N}_]|$)') AS h4, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])ing([^\p{L}\p{N}_]|$)') AS h5 FROM documents)
""")
def keyword_tags(t: Tables) -> DataFrame:
    """Free text to tags; short keywords as words, long ones anywhere."""
    return t.documents.select("doc_id", F.array_join(matching.keyword_tags(F.col("text"), _TAGS), ",").alias("tags"))


@query("""
WITH s AS (SELECT p_partkey, p_name, CASE WHEN p_type ILIKE '%steel%' AND p_type ILIKE '%nosuch%' AND p_type ILIKE '%ECONOMY%' THEN 0
  WHEN p_type ILIKE '%nosuch%' AND p_type ILIKE '%ECONOMY%' THEN 1 WHEN p_type ILIKE '%steel%' AND p_type ILIKE '%ECONOMY%' THEN 2 WHEN p_type ILIKE '%steel%' AND p_type ILIKE '%nosuch%' THEN 3
  WHEN p_type ILIKE '%steel%' THEN 4 WHEN p_type ILIKE '%nosuch%' THEN 5 WHEN p_type ILIKE '%ECONOMY%' THEN 6 END AS stage FROM part)
SELECT p_partkey, CAST(stage AS INT) AS stage FROM s WHERE stage = (SELECT min(stage) FROM s) ORDER BY p_partkey LIMIT 20
""")
def search_relaxation(t: Tables) -> DataFrame:
    """All terms, all but one, single terms: the first stage that finds anything."""
    return matching.relaxed_search(t.part, "p_type", "SNE", "p_partkey", {"SNE": "steel nosuch ECONOMY"}).select("p_partkey", "stage")


@query()
def fuzzy_match(t: Tables) -> DataFrame:
    """Labels against a catalog by similarity; checked against a plain version in the tests."""
    labels = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("label"))
    catalog = t.part.select("p_type").distinct().withColumn("code", F.sha2("p_type", 256))
    return matching.fuzzy_best(labels, "p_partkey", "label", catalog, "code", "p_type")


@query()
def mapping_ladder(t: Tables) -> DataFrame:
    """The first rung that holds for each label; checked against a plain version in the tests."""
    columns = t.part.select(F.col("p_partkey").alias("column_key"), F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 5 == 0, " - A").otherwise("")).alias("raw_label"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("code"))
    catalog = t.part.select(F.col("p_brand").alias("course_code"), F.col("p_brand").alias("name")).distinct()
    book = t.part.groupBy("p_type").agg(F.min("p_brand").alias("code")).select("code", F.col("p_type").alias("name"))
    aliases = t.part.select(F.col("p_partkey").alias("alias_id"), F.col("p_type").alias("alias_text"), F.col("p_brand").alias("course_code"))
    return matching.mapping_ladder(columns, catalog, aliases, book)


@query("""
WITH c AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN [] WHEN n_nationkey % 4 = 1 THEN ['A'] WHEN n_nationkey % 4 = 2 THEN ['B', 'C'] ELSE ['D'] END AS codes, n_nationkey % 4 = 0 AS is_open FROM nation),
g AS (SELECT n_regionkey, list_distinct(flatten(list(codes))) AS taken FROM c WHERE NOT is_open GROUP BY 1)
SELECT n_nationkey, array_to_string(CASE WHEN is_open THEN list_filter(['A', 'B', 'C', 'D', 'E', 'F'], lambda x: NOT list_contains(coalesce(taken, []), x)) ELSE codes END, ',') AS streams FROM c LEFT JOIN g USING (n_regionkey)
""")
def disjoint_complement(t: Tables) -> DataFrame:
    """Explicit claims by tag, and an open member that gets what its group leaves."""
    label = F.when(F.col("n_nationkey") % 4 == 0, "x [any subject]").when(F.col("n_nationkey") % 4 == 1, "x [Alpha]").when(F.col("n_nationkey") % 4 == 2, "x [beta] [Gamma]").otherwise("x [DELTA]")
    parsed = t.nation.withColumn("c", matching.claims(label, [("alpha", "A"), ("beta", "B"), ("gamma", "C"), ("delta", "D")], r"\bany\s+subject\b"))
    rows = parsed.select("n_nationkey", "n_regionkey", "c.codes", "c.is_open")
    return matching.disjoint_claims(rows, "n_regionkey", "codes", "is_open", list("ABCDEF")).select("n_nationkey", F.array_join("streams", ",").alias("streams"))


_BODY = "PROMO BRUSHED STEEL and Brand13 (old) then LOPPA"


@query(rf"""
SELECT DISTINCT p_brand, contains('{_BODY.upper()}', upper(replace(p_brand, '#', ''))) AS present FROM part
""")
def presence_check(t: Tables) -> DataFrame:
    """Whether codes stand in a text, forward or reversed."""
    brands = t.part.select("p_brand", F.replace("p_brand", F.lit("#"), F.lit("")).alias("code")).distinct()
    return matching.present_in(brands, "code", "code", _BODY).select("p_brand", "present")


_NORMAL = r"trim(regexp_replace(replace(regexp_replace(upper(replace({}, 'ß', 'ss')), '[#*]', ' ', 'g'), '&', ' AND '), '\s+', ' ', 'g'))"
_BARE = r"trim(regexp_replace(regexp_replace({}, '\([^()]*\)', ' ', 'g'), '\s+', ' ', 'g'))"


def _book(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Items of the benchmark as entries, their first word as code and three more as name, and all documents as pages."""
    words = F.split("text", " ")
    entries = t.benchmark.select("item_id", F.get(words, F.lit(0)).alias("code"), F.array_join(F.slice(words, 2, 3), " ").alias("name"))
    return t.documents.select(F.replace("text", F.lit("ß"), F.lit("ss")).alias("text")), entries


@query(rf"""
WITH pages AS (SELECT DISTINCT {_NORMAL.format("text")} AS f, {_NORMAL.format("reverse(text)")} AS b FROM documents WHERE text IS NOT NULL),
sides AS (SELECT f AS x, {_BARE.format("f")} AS bare FROM pages UNION ALL SELECT b, {_BARE.format("b")} FROM pages),
e AS (SELECT item_id, upper(string_split(text, ' ')[1]) AS code, {_BARE.format(_NORMAL.format("array_to_string(string_split(text, ' ')[2:4], ' ')"))} AS name FROM benchmark)
SELECT item_id, EXISTS (SELECT 1 FROM sides WHERE length(name) >= 4 AND contains(bare, name))
  OR EXISTS (SELECT 1 FROM sides WHERE contains(x, code) AND regexp_matches(x, '(^|[^A-Z0-9])' || regexp_escape(code) || '($|[^A-Z0-9])')) AS present FROM e
""")
def book_presence(t: Tables) -> DataFrame:
    """Which codes and names stand anywhere in all pages, forward or reversed, by one automaton."""
    pages, entries = _book(t)
    return joins.exists_flag(entries.select("item_id"), presence.find_present(pages, "text", entries, "item_id", "code", "name"), ["item_id"], "present")


_SPEND = "1 + event_id % 5"


@query(f"""
WITH RECURSIVE h AS (SELECT event_id, CAST(ts AS DATE) AS day, {_SPEND} AS n, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events),
s AS (
  SELECT event_id, day, i, n <= 200 AS allowed, CASE WHEN n <= 200 THEN n ELSE 0 END AS spent FROM h WHERE i = 1
  UNION ALL SELECT h.event_id, h.day, h.i, spent + n <= 200, CASE WHEN spent + n <= 200 THEN spent + n ELSE spent END FROM s JOIN h ON h.day = s.day AND h.i = s.i + 1
)
SELECT event_id, allowed FROM s
""")
def budget_spends(t: Tables) -> DataFrame:
    """Spends of several from a daily budget, all or nothing, in order."""
    return admission.spend(t.events.withColumn("n", F.expr(_SPEND)), "ts", "event_id", "n", 200)


@query("""
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
SELECT item_id, EXISTS (SELECT 1 FROM d WHERE len(list_intersect(d.w, b.w)) = len(b.w)) AS subset FROM b
""")
def word_subset(t: Tables) -> DataFrame:
    """Items all of whose words some document holds; each item meets only the documents that hold its rarest word."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    items = t.benchmark.select("item_id", words("text").alias("w"))
    return joins.words_held(items, "item_id", "w", t.documents.select(words("text").alias("w")), "w").select("item_id", "subset")


@query("""
SELECT o_orderkey, CASE WHEN t = 'NQC' THEN NULL WHEN t IN ('', '-') THEN 'MISSING' WHEN TRY_CAST(t AS DECIMAL(12,4)) IS NULL THEN 'UNPARSEABLE' WHEN TRY_CAST(t AS DECIMAL(12,4)) NOT BETWEEN -2 AND 4 THEN 'OUT_OF_RANGE' END AS problem,
  CAST(CASE WHEN t NOT IN ('NQC', '', '-') AND TRY_CAST(t AS DECIMAL(12,4)) BETWEEN -2 AND 4 THEN TRY_CAST(t AS DECIMAL(12,4)) END AS DOUBLE) AS value
FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'NQC' WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN '12.409' WHEN 4 THEN '-' ELSE '1.' || (o_orderkey % 10000) END AS t FROM orders)
""")
def ingest_parse(t: Tables) -> DataFrame:
    """Cells to values or problems."""
    m = F.col("o_orderkey") % 6
    raw = F.when(m == 0, "NQC").when(m == 1, "").when(m == 2, "abc").when(m == 3, "12.409").when(m == 4, "-").otherwise(F.concat(F.lit("1."), (F.col("o_orderkey") % 10000).cast("string")))
    return t.orders.select("o_orderkey", C.parse_value(raw).alias("v")).select("o_orderkey", "v.problem", "v.value")


@query("""
WITH n AS (SELECT o_orderkey, 'new' AS state FROM orders WHERE year(o_orderdate) = 1998), o AS (SELECT o_orderkey, 'old' AS state FROM orders WHERE o_orderstatus = 'F')
SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)
""")
def upsert_state(t: Tables) -> DataFrame:
    """The state of a keyed table after an upsert."""
    new = t.orders.where(C.in_year("o_orderdate", 1998)).select("o_orderkey", F.lit("new").alias("state"))
    old = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("old").alias("state"))
    return ingest.upsert(old, new, ["o_orderkey"])


@query("""
SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
""")
def insert_absent(t: Tables) -> DataFrame:
    """Rows that a table lacks, once for each key."""
    return ingest.insert_absent(t.orders.where("o_orderstatus = 'P'").select("o_custkey"), t.orders.where(C.in_year("o_orderdate", 1997)).select("o_custkey"), ["o_custkey"])


@query("""
SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'removed' ELSE 'added' END AS change_type,
 CASE WHEN c_custkey % 5 = 0 THEN 'skipped: not approved' WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey > 1000 THEN 'skipped: unknown' WHEN c_acctbal < 0 THEN 'skipped: already inactive' ELSE 'deactivated' END
  ELSE CASE WHEN c_custkey <= 1000 THEN 'skipped: exists' ELSE 'inserted' END END AS outcome FROM customer
""")
def apply_changes(t: Tables) -> DataFrame:
    """What each reviewed change does, or why it is skipped."""
    table = t.customer.where("c_custkey <= 1000").select("c_custkey", (F.col("c_acctbal") >= 0).alias("is_active"))
    changes = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "removed").otherwise("added").alias("change_type"), F.when(F.col("c_custkey") % 5 == 0, "pending").otherwise("approved").alias("status"))
    return ingest.apply_changes(table, changes, "c_custkey")


@query("""
WITH o AS (SELECT l_orderkey, string_agg(f || '=' || z, '; ' ORDER BY f) AS n FROM (SELECT l_orderkey, l_returnflag AS f, CAST(max(CAST(l_extendedprice AS DECIMAL(12,2))) AS VARCHAR) AS z FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderkey, coalesce(n, 'none') AS notes FROM orders LEFT JOIN o ON l_orderkey = o_orderkey
""")
def annotated_overrides(t: Tables) -> DataFrame:
    """Base rows with what each override says."""
    ov = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.max(F.col("l_extendedprice").cast("decimal(12,2)")).alias("z"))
    return ingest.annotate(t.orders.select("o_orderkey", F.lit("none").alias("notes")), ov, ["o_orderkey"], "l_returnflag", "z")


@query("""
SELECT page_id, host, score FROM (SELECT page_id, host, CASE WHEN host LIKE '%.org' THEN 2 WHEN host LIKE '%.com' THEN 1 ELSE 0 END AS score FROM (
  SELECT page_id, ltrim(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), 'w.') AS host FROM (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM pages) WHERE n = 1))
ORDER BY score DESC, page_id LIMIT 7
""")
def trust_ranked(t: Tables) -> DataFrame:
    """Dedupe, score by host, the best seven in order."""
    rows = t.pages.select("page_id", "url", F.lit(0).alias("source"))
    found = matching.trusted_first(rows, "url", "source", "page_id", ["org"], [".com"])
    return found.select("page_id", C.host(F.col("url")).alias("host"), "score")


@query("""
WITH RECURSIVE h AS (SELECT event_id, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
s AS (
  SELECT event_id, key, i, [t] AS times, true AS admitted, 0.0::DOUBLE AS retry_after FROM h WHERE i = 1
  UNION ALL
  SELECT event_id, key, i, CASE WHEN len(held) < 3 THEN list_append(held, t) ELSE held END, len(held) < 3, CASE WHEN len(held) < 3 THEN 0.0 ELSE 43200.0 - (t - held[1]) END
  FROM (SELECT h.event_id, h.key, h.i, h.t, list_filter(s.times, lambda x: h.t - x < 43200.0) AS held FROM s JOIN h ON h.key = s.key AND h.i = s.i + 1)
)
SELECT event_id, key, admitted, retry_after FROM s
""")
def sliding_admission(t: Tables) -> DataFrame:
    """Hits of each user admitted by a sliding window whose own decisions count; checked by a replay in the tests."""
    hits = t.events.select("event_id", F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return admission.admit(hits, "key", "t", "event_id", limit=3, window=43200.0)


@query("""
SELECT event_id, n <= 100 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)
""")
def daily_budget(t: Tables) -> DataFrame:
    """A budget for each UTC day, spent in order."""
    return admission.daily_budget(t.events, "ts", "event_id", 100)


@query("""
SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers, left(text, 40) AS head, lpad(CAST(doc_id AS VARCHAR), 6, '0') AS padded, reverse(left(text, 10)) AS tail FROM documents
""")
def scalar_text(t: Tables) -> DataFrame:
    """Scalar functions: find-all, left, pad, reverse."""
    numbers = F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long")
    return t.documents.select("doc_id", numbers.alias("n_numbers"), F.left("text", F.lit(40)).alias("head"), F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("padded"), F.reverse(F.left("text", F.lit(10))).alias("tail"))


@query("""
WITH e AS (SELECT user_id, epoch(ts) AS s, event_id FROM events), b AS (SELECT user_id, s, event_id, CAST(floor(s / 86400) AS BIGINT) AS day FROM e)
SELECT user_id, day, count(*) AS n, CAST(min(event_id) AS BIGINT) AS first_id FROM b GROUP BY 1, 2
""")
def daily_activity(t: Tables) -> DataFrame:
    """D29 in bulk: activity of each user by day."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000)).cast("long")
    return t.events.groupBy("user_id", day.alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id
""")
def parent_with_children(t: Tables) -> DataFrame:
    """A parent with its ordered children."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"])
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(rows, ">").alias("roles"))


@query("""SELECT * FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n, c_mktsegment FROM customer) WHERE n <= 3""")
def top_per_group(t: Tables) -> DataFrame:
    """The best few of each group."""
    top = windows.first_of(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return top.select("c_custkey", "c_mktsegment", place.cast("long").alias("n"))
