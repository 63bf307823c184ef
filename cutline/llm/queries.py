"""The queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, chat, decontam, langid, neardup, pii, ranked, repetition, sharding, token_store, trie, urls, word_bpe
from .shared import WORDS

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo a divisor; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    crf = langid.train(docs, remainder(4) != 2)
    found = langid.predict(docs, crf)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "n_switches")


def op2_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents"))


def op8_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    forest = boosting.train(docs, _table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = boosting.score(docs, forest)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 8)


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    everything = pii.written(F.concat("spans", "term_spans"))
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("spans")), 256).alias("base_sha256"), everything.alias("spans"))


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.hex("tid").alias("text_id"), "kept")


def op9_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    written = chat.format_paths(chat.best_paths(chat.chain(rows.unionByName(extra))))
    turns, learned = chat.parse(F.col("formatted")), chat.learned_text(F.col("formatted"), F.col("loss_spans"))
    read = written.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def tokenizer(name: str) -> str:
    from public_tokenizers import path

    return path(name)


def op4_perfect_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return token_store.read_digests(manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


def op10_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")
    return word_bpe.encode_digests(docs, path, word_bpe.build_lexicon(docs, path))


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first h turns of conversation c - c % 20 in front of its own after the first h, h = crc32(c) % 4."""
    base = trie.lengths(turns)
    c, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string")) % 4
    convs = base.withColumns({"h": h, "p": c - c % 20}).join(base.select(F.col("conv_id").alias("p"), F.col("length").alias("n_p")), "p", "left")
    convs = convs.withColumn("led", F.least("h", F.coalesce("n_p", F.lit(0)))).select("conv_id", "h", "p", "led", "length")
    heads = turns.where("conv_id % 20 = 0 AND pos <= 3").withColumnRenamed("conv_id", "p")
    first = convs.join(heads, "p").where("pos <= h").select("conv_id", "pos", "key", "words")
    rest = turns.join(convs.select("conv_id", "h", "led"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("led")).alias("pos"), "key", "words")
    return first.unionByName(rest), convs.select("conv_id", (F.col("led") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = trie.build(*_rebuilt(trie.number_turns(_table(spark, sf_dir, "conversations"))))
    return trie.with_digests(nodes, ends)


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build_index(_table(spark, sf_dir, "documents"))
    return ranked.search(index, _table(spark, sf_dir, "benchmark"), 50)


#: Host, path and verdict of the rules for pages.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op13_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


_OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
sizes AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
g AS (
  SELECT r, i, 5 AS n, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS k, lead(w, 4) OVER p AS e FROM w WINDOW p AS (PARTITION BY r ORDER BY i)
  UNION ALL
  SELECT r, i, 8, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p, lead(w, 5) OVER p, lead(w, 6) OVER p, lead(w, 7) OVER p), lead(w, 7) OVER p FROM w WINDOW p AS (PARTITION BY r ORDER BY i)
  UNION ALL
  SELECT r, i, 12, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p, lead(w, 5) OVER p, lead(w, 6) OVER p, lead(w, 7) OVER p, lead(w, 8) OVER p, lead(w, 9) OVER p, lead(w, 10) OVER p, lead(w, 11) OVER p), lead(w, 11) OVER p FROM w WINDOW p AS (PARTITION BY r ORDER BY i)
),
twice AS (SELECT r, n, i FROM (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, k) AS c FROM g WHERE e IS NOT NULL) WHERE c > 1),
inside AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM twice),
cover AS (
  SELECT r, count(*) FILTER (n = 5) AS n_repeat_words, sum(length(w)) FILTER (n = 5) AS dup5_chars,
         sum(length(w)) FILTER (n = 8) AS dup8_chars, sum(length(w)) FILTER (n = 12) AS dup12_chars
  FROM inside JOIN w USING (r, i) GROUP BY r
),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
again AS (SELECT r, l FROM (SELECT r, l, row_number() OVER (PARTITION BY r, l ORDER BY i) AS c FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]')) WHERE c > 1),
lines AS (SELECT r, count(*) AS n_dup_lines, sum(list_sum(list_transform(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda x: length(x)))) AS dup_line_chars FROM again GROUP BY r),
m AS (
  SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
    CAST(coalesce(dup5_chars, 0) AS BIGINT) AS dup5_chars, CAST(coalesce(dup8_chars, 0) AS BIGINT) AS dup8_chars, CAST(coalesce(dup12_chars, 0) AS BIGINT) AS dup12_chars
  FROM d LEFT JOIN sizes USING (r) LEFT JOIN cover USING (r) LEFT JOIN lines USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * dup_line_chars > 30 * word_chars
       OR 100 * dup5_chars > 20 * word_chars OR 100 * dup8_chars > 17 * word_chars OR 100 * dup12_chars > 15 * word_chars) AS kept
FROM m
"""


def _crc_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


#: The unsigned crc32 of the UTF-8 bytes of t.
_CRC_SQL = f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST(('0x' || h) AS BIGINT)),
  lambda c, b: xor(c // 256, {_crc_table()}[xor(c % 256, b) + 1]), 4294967295), 4294967295)"""

_OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, CAST(strlen(t) + 1 AS BIGINT) AS size, sum(strlen(t) + 1) OVER (ORDER BY doc_id) AS ending, sum(strlen(t) + 1) OVER () AS total FROM d),
p AS (SELECT *, CAST(least(7, (2 * ending - size) * 8 // (2 * total)) AS INT) AS shard FROM s)
SELECT doc_id, size, {_CRC_SQL} AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM p
"""

_OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontam.WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontam.WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT r, item_id, i, dw.n FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r),
places AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
bi AS (SELECT row_number() OVER () AS item, item_id, w FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
rare AS (
  SELECT item, item_id, word, row_number() OVER (PARTITION BY item ORDER BY n, word) AS k
  FROM (SELECT DISTINCT item, item_id, unnest(w) AS word FROM bi) JOIN (SELECT word, count(*) AS n FROM places GROUP BY word) USING (word)
),
near AS (SELECT *, max(k) OVER (PARTITION BY item) AS wanted FROM rare WHERE k <= {decontam.NEAR_TERMS}),
last AS (
  SELECT r, item_id, pos, wanted, max(pos) FILTER (k = 1) OVER u AS p1, max(pos) FILTER (k = 2) OVER u AS p2, max(pos) FILTER (k = 3) OVER u AS p3
  FROM places JOIN near USING (word) WINDOW u AS (PARTITION BY r, item ORDER BY pos)
),
close AS (
  SELECT r, count(DISTINCT item_id) AS n_near FROM last
  WHERE (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT + (p3 IS NOT NULL)::INT = wanted AND pos - least(coalesce(p1, pos), coalesce(p2, pos), coalesce(p3, pos)) + 1 <= {decontam.NEAR_SPAN}
  GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r) LEFT JOIN close USING (r)
"""

_ESCAPED = "replace({}, '\\', '\\\\')"
for _c in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
s AS (SELECT *, {_ESCAPED.format("text")} AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(body) + {len(chat.START) + len(chat.END) + 2}) AS BIGINT) AS formatted_chars
FROM s WHERE conv_id IS NOT NULL GROUP BY conv_id
"""

_OP11_SQL = f"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
c AS (SELECT conv_id, {_CRC_SQL} % 4 AS h, conv_id - conv_id % 20 AS p FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS t FROM n)),
r AS (
  SELECT c.conv_id, pos AS d, role, text FROM c JOIN o ON o.conv_id = c.p AND pos <= h
  UNION ALL
  SELECT c.conv_id, pos - h + least(h, coalesce(n, 0)), role, text FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h LEFT JOIN n ON n.conv_id = c.p
),
x AS (
  SELECT conv_id, d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS pre,
    len(regexp_extract_all(text, '{WORDS}')) AS words FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
),
nodes AS (
  SELECT g.*, u.pre AS up FROM (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM x GROUP BY d, pre) g
  LEFT JOIN x u ON u.conv_id = g.conv_id AND u.d = g.d - 1
),
kids AS (SELECT d - 1 AS d, up AS pre, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT nodes.conv_id, d, coalesce(k, 0) = 0 AS leaf, (n_convs - 1) * words AS saved FROM nodes LEFT JOIN kids USING (d, pre)),
rolled AS (SELECT x.d, x.pre, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM own JOIN x ON x.conv_id = own.conv_id AND x.d <= own.d GROUP BY ALL),
ended AS (SELECT d, pre, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM x QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY ALL)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(k, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN rolled USING (d, pre) LEFT JOIN kids USING (d, pre) LEFT JOIN ended USING (d, pre)
LEFT JOIN nodes parent ON parent.d = nodes.d - 1 AND parent.pre = nodes.up
"""

_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS_SQL} AS w FROM documents) WHERE len(w) > 0),
total AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark WHERE item_id IS NOT NULL)),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, total GROUP BY term, all_docs),
s AS (
  SELECT item_id, r, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), total GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
FROM s JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 50
"""


def _op13_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{pick(h, p, v)}'" for h, p, v in longest) + " END"
    given = lambda c: f"{c} * {100 - urls.DAMPING} // 100"
    rounds = "".join(f""",
r{i} AS MATERIALIZED (
  SELECT host, CAST({given("s.trust")} + coalesce(t, 0) AS BIGINT) AS trust, CAST({given("s.distrust")} + coalesce(b, 0) AS BIGINT) AS distrust, n_out, n_in FROM start s LEFT JOIN (
    SELECT host, sum(t) AS t, sum(b) AS b FROM (
      SELECT e.b AS host, trust * {urls.DAMPING} // (100 * n_out) AS t, 0 AS b FROM e JOIN r{i - 1} ON host = e.a
      UNION ALL SELECT e.a, 0, distrust * {urls.DAMPING} // (100 * n_in) FROM e JOIN r{i - 1} ON host = e.b) GROUP BY host
  ) USING (host)
)""" for i in range(1, urls.ROUNDS + 1))
    return rf"""
WITH u AS (SELECT page_id, html, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
p AS (SELECT page_id, html, {lower.format("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM u),
ruled AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said FROM p),
seeds AS (
  SELECT host, count(*) FILTER (said = 'allow') * {urls.ONE} // count(*) AS trust, count(*) FILTER (said = 'block') * {urls.ONE} // count(*) AS distrust
  FROM ruled WHERE host <> '' GROUP BY host
),
linked AS (SELECT DISTINCT host AS a, b FROM (SELECT host, {lower.format("unnest(regexp_extract_all(html, '" + urls.LINK.replace("'", "''") + "', 1))")} AS b FROM p) WHERE host <> '' AND b <> '' AND host <> b),
known AS (SELECT host FROM seeds UNION SELECT a FROM linked UNION SELECT b FROM linked),
labels AS (SELECT string_split(host, '.') AS l FROM known),
e AS MATERIALIZED (
  SELECT a, b FROM linked
  UNION SELECT array_to_string(l[i:], '.'), array_to_string(l[i + 1:], '.') FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels) WHERE array_to_string(l[i:], '.') <> ''
),
start AS MATERIALIZED (
  SELECT host, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in
  FROM (SELECT host FROM known UNION SELECT a FROM e UNION SELECT b FROM e) LEFT JOIN seeds USING (host)
  LEFT JOIN (SELECT a AS host, count(*) AS n_out FROM e GROUP BY a) USING (host) LEFT JOIN (SELECT b AS host, count(*) AS n_in FROM e GROUP BY b) USING (host)
),
r0 AS (SELECT host, {given("trust")} AS trust, {given("distrust")} AS distrust, n_out, n_in FROM start){rounds}
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust >= {urls.LEAST * (100 - urls.DAMPING) // 100} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled LEFT JOIN r{urls.ROUNDS} USING (host)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_crf, op2_repetition_coverage, op3_byte_prefix_shards, op4_perfect_hash_ids, op5_positional_index, op6_disclosing_terms, op7_weighted_minhash, op8_boosted_quality, op9_reply_tree_chat, op10_transducer_bpe, op11_prefix_trie, op12_block_max_wand, op13_link_trust)}


def oracle_sql() -> dict[str, str]:
    return {"op2_repetition_coverage": _OP2_SQL, "op3_byte_prefix_shards": _OP3_SQL, "op5_positional_index": _OP5_SQL, "op9_reply_tree_chat": _OP9_SQL, "op11_prefix_trie": _OP11_SQL, "op12_block_max_wand": _OP12_SQL, "op13_link_trust": _op13_sql()}
