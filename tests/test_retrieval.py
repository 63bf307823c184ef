"""Neighbours, full-text search and presence against plain versions."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cutline.functions.stem import stem
from cutline.operators import fulltext, joins, presence, vectors

SCHEMA = "chunk_id long, label string, embedding array<float>"


def random_vectors(n, size=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size)) * 3
    return [(i, f"g{i % 3}" if i % 7 else None, [float(x) for x in (centres[i % 12] + rng.normal(size=size)).astype(np.float32)]) for i in range(n)]


def plain_nearest(rows, queries, k):
    good = [(i, np.array(v, np.float64)) for i, _, v in rows if v and None not in v and len(v) == 8 and any(v)]
    out = {}
    for q, _, v in queries:
        if v and None not in v and len(v) == 8 and any(v):
            v = np.array(v, np.float64)
            scored = sorted(((-(x @ v) / np.sqrt((x @ x) * (v @ v)), i) for i, x in good), key=lambda s: (round(s[0], 12), s[1]))
            out[q] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("rows_at_once, asked_at_once", [(vectors.BLOCK_ROWS, vectors.BLOCK_QUERIES), (40, 7)])
def test_nearest_in_blocks(spark, monkeypatch, rows_at_once, asked_at_once):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", rows_at_once)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", asked_at_once)
    rows = random_vectors(300)
    rows += [(1000 + i, "g0", rows[5][2]) for i in range(30)] + [(2000, "g0", None), (2001, "g1", [0.0] * 8), (2002, "g1", [1.0, None] * 4), (2003, "g2", [1.0])]
    chunks = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit(1), "__q": F.lit(2), "similarity": F.lit(3)}).repartition(5)
    asked = [r for r in rows if r[0] % 9 == 0 or r[0] >= 2000]
    queries = spark.createDataFrame(asked, SCHEMA).select(F.col("chunk_id").alias("query_id"), "embedding")
    got: dict = {}
    for r in vectors.nearest(chunks, queries, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == plain_nearest(rows, asked, 6)
    best = {(r.query_id, r.label): r.similarity for r in vectors.best_of_groups(chunks, queries, "label").collect()}
    assert len(best) == 4 * len(got)
    for (q, label), s in best.items():
        v = np.array(next(r[2] for r in rows if r[0] == q))
        held = [np.array(r[2]) for r in rows[:330] if r[1] == label]
        assert s == pytest.approx(max(x @ v / np.sqrt((x @ x) * (v @ v)) for x in held))
    assert vectors.nearest(chunks, queries.limit(0), 3).count() == vectors.nearest(chunks.limit(0), queries, 3).count() == 0


def test_index_recall(spark, monkeypatch):
    """Nine of ten neighbours at least with a few probes; all with as many probes as lists; a hot list is cut into parts."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 10)
    rows = random_vectors(600) + [(5000 + i, "hot", [float(x == 2) + i * 1e-4 for x in range(8)]) for i in range(300)] + [(9000, None, None)]
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(4)
    queries = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    index = vectors.build_index(chunks, lists=24, sample=200)
    exact = vectors.nearest(chunks, queries, 10)
    assert index.lists.count() == 900 and index.parts.agg(F.max("n_parts")).first()[0] > 1
    assert index.probes < 24 and vectors.recall(vectors.search(index, queries, 10), exact, "query_id", "chunk_id") >= 0.9
    assert vectors.recall(vectors.search(index, queries, 10, 24), exact, "query_id", "chunk_id") == 1.0
    empty = vectors.build_index(chunks.limit(0))
    assert vectors.search(empty, queries, 3).count() == 0


def test_index_recall_over_the_tables(spark):
    chunks = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = chunks.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    found = vectors.search(vectors.build_index(chunks), queries, 10)
    assert vectors.recall(found, vectors.nearest(chunks, queries, 10), "query_id", "chunk_id") >= 0.9


def test_words_held(spark):
    rng = random.Random(2)
    some = lambda n, k: [[f"w{rng.randint(0, 12)}" for _ in range(rng.randint(0, k))] for _ in range(n)]
    texts, items = some(30, 7) + [None, []], [sorted(set(w)) for w in some(80, 4)]
    got = joins.words_held(spark.createDataFrame(list(enumerate(items)), "k int, w array<string>"), "k", "w", spark.createDataFrame([(t,) for t in texts], "t array<string>"), "t").collect()
    assert {r.k: r.subset for r in got} == {i: any(set(w) <= set(t or []) for t in texts) for i, w in enumerate(items)}


def test_words_held_broadcasts_no_texts(spark):
    """Stored words take few bytes for their many rows; they are merged, not sent to the driver by the size of their files."""
    texts = spark.range(20_000).select(F.array(*(F.lit(f"w{i}") for i in range(6))).alias("t"))
    items = spark.createDataFrame([(1, ["w1", "w2"]), (2, ["w1", "other"])], "k int, w array<string>")
    found = joins.words_held(items, "k", "w", texts, "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin.*__id#", plan) and not re.search(r"BroadcastHashJoin \[__id#", plan)
    assert {r.k: r.subset for r in found.collect()} == {1: True, 2: False}


PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consolatory consolatori knightly knight knots knot kneeling kneel
generate generat generously generous general general generation generat communication communic arsenic arsenic dying die skies sky cries cri ties tie gas gas gaps gap kiwis kiwi hopping hop hoping hope
luxuriated luxuri national nation relational relat rational ration conditional condit valency valenc digitizer digit operator oper feudalism feudal hopefulness hope formality formal sensitivity sensit
sensibility sensibl triplicate triplic electrical electr goodness good revival reviv allowance allow adjustment adjust adoption adopt probate probat rate rate cease ceas controlling control rolling roll
happy happi by by say say cry cri enjoy enjoy inning inning proceed proceed succeeded succeed only onli agreed agre feed feed plastered plaster motoring motor sing sing conflated conflat troubled troubl
sized size falling fall hissing hiss failing fail filing file archaeology archaeolog quickly quick daily daili news news bias bias youth youth yellow yellow apology apolog caresses caress ponies poni"""


def test_stems():
    words = PAIRS.split()
    assert [stem(w) for w in words[::2]] == words[1::2]
    assert stem("") == "" and stem("é") == "é" and stem("2024") == "2024"


def plain_search(docs, queries, k):
    def lexemes(text):
        return [(i, stem(w)) for i, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower()), 1) if w not in fulltext.STOP_WORDS]

    out = []
    for q, text in queries:
        terms = sorted({t for _, t in lexemes(text)})
        scored = []
        for key, head, body in docs:
            first = lexemes(head)
            base = max((i for i, _ in first), default=0)
            said = [(i, t, 1.0) for i, t in first] + [(base + i, t, np.float32(0.1)) for i, t in lexemes(body)]
            at = [[(i, w) for i, t, w in said if t == term] for term in terms]
            if not terms or key is None or not all(at):
                continue
            if len(terms) == 1:
                top = max(range(len(at[0])), key=lambda n: (at[0][n][1], -n))
                score = (at[0][top][1] + sum(w / (n + 1) ** 2 for n, (_, w) in enumerate(at[0]) if n != top)) / (math.pi**2 / 6)
            else:
                left = 1.0
                for a in range(len(terms)):
                    for b in range(a):
                        for i, v in at[a]:
                            for j, w in at[b]:
                                d = abs(i - j)
                                left *= 1 - math.sqrt(v * w * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
                score = 1 - left
            scored.append((-round(score, 7), key))
        out += [(q, key, pytest.approx(-s, abs=2e-7), rank) for rank, (s, key) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_fulltext(spark):
    rng = random.Random(4)
    words = "run running runner the of generally generation knights knot hoping hops 2024 Été x y z apology".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 3))), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(60)]
    docs += [(100, None, None), (101, "", "filler " * 150 + "knight apology " + "filler " * 300 + "run"), (None, "knight", "run"), (102, "Knights", "runs"), (103, "Knights", "runs")]
    queries = [(1, "running knights"), (2, "knots"), (3, "the of"), (4, None), (5, "nowhere knight"), (6, "hope, hope! generation 2024"), (7, "ÉTÉ"), (8, "apologies run knight")]
    table = spark.createDataFrame(docs, "doc_id long, head string, body string").withColumns({"term": F.lit("t"), "n": F.lit(1), "places": F.lit(2)}).repartition(4)
    postings = fulltext.build_postings(table, "doc_id", [("head", "A"), ("body", "D")])
    asked = spark.createDataFrame(queries, "query_id long, said string")
    got = fulltext.search(postings, asked, "query_id", "said", 70).orderBy("query_id", "rank").collect()
    assert len(got) > 60
    expected = plain_search(docs, queries, 70)
    assert [(r.query_id, r["rank"]) for r in got] == [(q, rank) for q, _, _, rank in expected]
    assert sorted((r.query_id, r.doc_id) for r in got) == sorted((q, key) for q, key, _, _ in expected)
    assert [r.score for r in got] == [s for _, _, s, _ in expected]
    assert fulltext.search(fulltext.build_postings(table.limit(0), "doc_id", [("head", "A")]), asked, "query_id", "said", 3).count() == 0
    assert fulltext.search(postings, asked.limit(0), "query_id", "said", 3).count() == 0


def test_fulltext_writes_no_pairs(spark, monkeypatch):
    """Over shards and rounds the results stay exact, and what is written grows with queries and documents, not with their pairs."""
    monkeypatch.setattr(fulltext, "SHARD_CHARS", 900, raising=False)
    monkeypatch.setattr(fulltext, "FIRST_SHARDS", 2, raising=False)
    monkeypatch.setattr(fulltext, "GROWTH", 2, raising=False)
    written = []

    def counted(df, name, stash=fulltext.stash):
        held = stash(df, name)
        if name != "postings":
            written.append(held.count())
        return held

    monkeypatch.setattr(fulltext, "stash", counted)
    rng = random.Random(8)
    docs = [(i, "", " ".join(rng.choices("knight hoping run x2 y2 z2".split(), k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(400 + i, "", "knight " + "run knight " * 300) for i in range(5)] + [(500 + i, "", "hoping") for i in range(20)]
    queries = [(i, " ".join(rng.sample("knight hoping run x2 y2 z2".split(), rng.randint(1, 4)))) for i in range(30)]
    table = spark.createDataFrame(docs, "doc_id long, head string, body string").repartition(4)
    postings = fulltext.build_postings(table, "doc_id", [("head", "A"), ("body", "D")])
    asked = spark.createDataFrame(queries, "query_id long, said string")
    got = fulltext.search(postings, asked, "query_id", "said", 3).orderBy("query_id", "rank").collect()
    expected = []
    for q, text in queries:
        scored = []
        for key, _, body in docs:
            said = [(i, stem(w)) for i, w in enumerate(body.split(), 1)]
            at = [[i for i, t in said if t == term] for term in sorted({stem(w) for w in text.split()})]
            if all(at):
                scored.append((-fulltext.rank_of([(p, [float(np.float32(0.1))] * len(p)) for p in at]), key))
        expected += [(q, key, -s) for s, key in sorted(scored)[:3]]
    assert [(r.query_id, r.doc_id, r.score) for r in got] == expected
    assert max(written) <= len(queries) * 3


def test_fulltext_meets_sets_together(monkeypatch):
    """A shard meets all sets of as many terms at once, and gives the ranks of ``rank_of`` to the last digit, with and without floors."""
    rng, weights = np.random.default_rng(9), (1.0, float(np.float32(0.1)))
    words = [f"w{i}" for i in range(30)]
    texts = [tuple(" ".join(rng.choice(words, n, p=np.arange(30, 0, -1) / 465)) for n in (int(rng.integers(0, 4)), int(rng.integers(0, 160)))) for _ in range(150)]
    texts += [("w1 w2", "w3 w4 " * 300)] * 30
    keys = rng.permutation(len(texts)).tolist()
    table = pa.Table.from_batches([fulltext._shard(0, keys, pa.int64(), texts, {})])
    sets = [sorted(rng.choice(words, n, replace=False).tolist()) for n in (1, 2, 3, 4) for _ in range(12)] + [["w3", "w4"], ["nowhere"], ["w1", "nowhere"]]
    at = {}
    for key, fields in zip(keys, texts, strict=True):
        base = 1
        for weight, text in zip(weights, fields, strict=True):
            for i, w in enumerate(text.split()):
                at.setdefault(key, {}).setdefault(w, []).append((base + i, weight))
            base += len(text.split())
    wanted = {}
    for s, terms in enumerate(sets):
        scored = [(-fulltext.rank_of([tuple(zip(*own[t], strict=True)) for t in terms]), key) for key, own in at.items() if all(t in own for t in terms)]
        wanted[s] = sorted(scored)[:8]
    met, meet = [], fulltext._Shard.meet
    monkeypatch.setattr(fulltext._Shard, "meet", lambda self, terms: met.append(1) or meet(self, terms))

    def found(floors):
        sheet = pa.table({"set": range(len(sets)), "terms": pa.array(sets, pa.list_(pa.string())), "floor": pa.array([f and -f[0] for f in floors], pa.float64()), "floor_key": pa.array([f and f[1] for f in floors], pa.int64())})
        got = {s: [] for s in range(len(sets))}
        for row in fulltext._search_shard(table, weights, "key", pa.int64(), 8, sheet).to_pylist():
            got[row["set"]].append((-row["score"], row["key"]))
        return {s: sorted(rows) for s, rows in got.items()}

    assert found([None] * len(sets)) == wanted
    assert len(met) == 4
    assert found([wanted[s][3] if len(wanted[s]) == 8 else None for s in wanted]) == {s: rows[:3] if len(rows) == 8 else rows for s, rows in wanted.items()}


def plain_present(pages, entries):
    norm = lambda s: re.sub(r"\s+", " ", re.sub("[#*]", " ", s.upper()).replace("&", " AND ")).strip()
    bare = lambda s: re.sub(r"\s+", " ", re.sub(r"\([^()]*\)", " ", s)).strip()
    sides = [norm(x) for p in pages for x in (p or "", (p or "")[::-1])]
    out = set()
    for key, code, name in entries:
        base = name or ""
        if base.endswith(")"):
            depth = 0
            for i in range(len(base) - 1, -1, -1):
                depth += (base[i] == ")") - (base[i] == "(")
                if depth == 0:
                    base = base[:i]
                    break
        phrase, code = bare(norm(base)), (code or "").strip().upper()
        if len(phrase) >= 4 and any(phrase in bare(s) for s in sides) or code and any(re.search(rf"(?<![A-Z0-9]){re.escape(code)}(?![A-Z0-9])", s) for s in sides):
            out.add(key)
    return out


@pytest.mark.parametrize("n", [50_000, 3])
def test_presence_by_automaton(spark, monkeypatch, n):
    monkeypatch.setattr(presence, "BLOCK_ENTRIES", n)
    monkeypatch.setattr(presence, "BLOCK_PAGES", n)
    rng = random.Random(6)
    codes = [f"{i:03}{'ABC'[i % 3]}" for i in range(60)]
    pages = [" ".join(rng.choice([*codes, "arts", "(TV)", "law", "x001A", "é012A", "management *studies", "R&D"]) for _ in range(12)) for _ in range(9)]
    pages += ["management studies (TV) - b and more"[::-1], "020C"[::-1] + " mirrored", None, "", "Ab" * 4000]
    entries = [(i, c, f"name {i}") for i, c in enumerate(codes)]
    entries += [(100, None, "Management Studies (TV) - B"), (101, "", "Arts law (Univ. of (North))"), (102, " 020c ", None), (103, "zz9", "TV"), (104, "none", "R & D"), (105, "none", "not there"), (105, "none", "law"), (106, "ABAB", "never"), (None, "001B", "law")]
    found = presence.find_present(spark.createDataFrame([(p,) for p in pages], "text string").repartition(3), "text", spark.createDataFrame(entries, "k int, code string, name string"), "k", "code", "name")
    got = [r.k for r in found.collect()]
    assert set(got) == plain_present(pages, [e for e in entries if e[0] is not None]) and len(got) == len(set(got))
    assert 100 in got and 106 not in got and 0 < len(got) < 70


def test_what_is_printed_elsewhere_is_not_removed(spark):
    active = spark.createDataFrame([("A", True), ("B", True), ("C", False), ("D", True)], "code string, is_active boolean")
    old = spark.createDataFrame([("A", "d1", 1.0), ("A", "d2", 2.0), ("A", "d3", None), ("B", "d1", 1.0), ("D", "d1", 1.0)], "code string, district string, z double")
    new = spark.createDataFrame([("A", "d1", 1.00005), ("A", "d2", None), ("A", "d3", 3.0), ("C", "d1", 2.0), ("E", "d1", 1.0), ("E", "d2", None)], "code string, district string, z double")
    printed = spark.createDataFrame([("B",)], "code string")
    got = {r.code: r for r in presence.diff_with_book(old, new, active, "code", "district", "z", printed).collect()}
    assert {k: r.kind for k, r in got.items()} == {"A": "changed", "D": "removed", "E": "added"} and got["E"].n_members == 1
    assert [(d.member, d.was, d.now) for d in got["A"].details] == [("d2", 2.0, None), ("d3", None, 3.0)] or got["A"].n_changed == 3
    assert {r.code for r in presence.diff_with_book(old, new, active, "code", "district", "z").where("kind = 'removed'").collect()} == {"B", "D"}
