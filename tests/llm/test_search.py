"""The prefix trie, ranked search and link trust against plain versions, and on odd and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cutline.llm import queries, ranked, trie, urls
from cutline.llm.queries import RULES


def plain_trie(rows):
    """rows: conv_id, turn, role, text -> the query's nodes."""
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(x)] for c, x in talks.items()}
    new = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = tuple(talks.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members[new[c][:d]].append(c)
    out = {}
    for pre in sorted(members, key=len, reverse=True):
        kids = [p for p in members if len(p) == len(pre) + 1 and p[:-1] == pre]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", pre[-1][1])) if pre else 0
        ends = ",".join(str(c) for c in members[pre] if len(new[c]) == len(pre))
        out[pre] = (
            members[pre][0], len(pre), members[pre[:-1]][0] if pre else None, len(members[pre]), len(kids), sum(out[k][5] for k in kids) or 1,
            sum(out[k][6] for k in kids) + (len(members[pre]) - 1) * words, hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("pos", "key", "words", "node", "depth", "length")})
    nodes, ends = trie.build(*queries._rebuilt(trie.number_turns(table.repartition(3))))
    return sorted((tuple(r) for r in trie.with_digests(nodes, ends).select(*COLUMNS).collect()), key=str)


def test_trie(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in [*range(45), -3, -40, 10**12]:
        for turn in range(int(rng.integers(0, 6))):
            rows.append((c, turn, ["user", "assistant"][turn % 2], ["hello there", "yes", "no  no", ""][int(rng.integers(0, 4) * (turn > 1))]))
    rows += [(3, None, None, None), (3, 1, "user", "tie"), (3, 1, "user", "a tie"), (3, 1, "user", "a tie"), (None, 0, "user", "nobody"), (7, 9, "user", "long " * 30_000), (8, 2, "", "x\x00é🙂")]
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(40) for t in range(4)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_one_and_none(spark):
    assert trie_of(spark, []) == []
    for rows in ([(5, 0, "user", "hi")], [(4, 0, "user", "hi")], [(23, None, None, None)]):
        assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_pieces(spark, monkeypatch):
    """Ids of one node are hashed piece by piece."""
    monkeypatch.setattr(trie, "PIECE", 16)
    ends = spark.range(-50, 3000).select(F.lit(-50).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("depth"), F.col("id").alias("member")).repartition(5)
    got = trie.digests(ends).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, range(-50, 3000))).encode()).hexdigest()]


# ranked search ------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, k):
    held = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(cut(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranks_of(spark, docs, items, k, **how):
    table = docs.select("doc_id", "text")
    items = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "term", "w", "block")})
    return sorted((tuple(r) for r in ranked.search(ranked.build_index(docs, **how), items, k).collect()), key=str), [tuple(r) for r in table.collect()]


def test_ranks(spark, prose, odd):
    said = [r.text for r in prose.limit(6).collect()]
    items = [(i, " ".join(t.split()[2:9])) for i, t in enumerate(said)] + [(None, "no id"), (50, None), (51, ""), (52, "the CAT é" + "é" * 2), (52, "and the dog"), (53, "unknownword"), (54, said[0])]
    for docs in (prose, odd, prose.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))):
        for k, size in ((50, 1 << 24), (3, 4000)):  # one shard a task, and many
            got, table = ranks_of(spark, docs, items, k, shard_bytes=size)
            assert got == plain_ranks(table, items, k)
    assert ranks_of(spark, prose.limit(0), items, 5)[0] == [] and ranks_of(spark, prose, [], 5)[0] == []


def test_one_index_serves_other_items(spark, prose):
    """The index holds the terms of all documents, so a second set of items needs no other one; items are searched in blocks."""
    docs = [tuple(r) for r in prose.select("doc_id", "text").collect()]
    index = ranked.build_index(prose, shard_bytes=5000)
    assert index.rows.where("n_docs = 0").count() > 3  # a sheet of ids for each shard
    for part in (docs[:30], docs[40:45]):
        items = [(i, " ".join(t.split()[:6])) for i, t in part]
        got = ranked.search(index, spark.createDataFrame(items, "item_id long, text string"), 4)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranks(docs, items, 4)


def test_items_in_blocks(spark, prose, monkeypatch):
    monkeypatch.setattr(ranked, "AT_ONCE", 3)
    docs = [tuple(r) for r in prose.select("doc_id", "text").collect()]
    items = [(i, " ".join(t.split()[3:8])) for i, t in docs[:14]]
    got, _ = ranks_of(spark, prose, items, 5)
    assert got == plain_ranks(docs, items, 5)


def test_many_equal_scores(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same words again").otherwise("none").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(9000, "other text"), (None, "the same words again")], "doc_id long, text string"))
    got, table = ranks_of(spark, docs, [(1, "same text")], 50, shard_bytes=8000)
    assert got == plain_ranks(table, [(1, "same text")], 50) and len(got) == 50


def test_cuts_are_the_cheapest(monkeypatch):
    """Boundaries equal those of an exhaustive search over short lists; long lists are cut into stretches."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ranked, "BLOCK_COST", 1000.0)

    def cost(values, ends):
        return sum((e - b) * values[b:e].max() + 1000.0 for b, e in zip([0, *ends], ends, strict=False))

    for _ in range(40):
        values = rng.integers(1, 1000, rng.integers(1, 11)).astype(np.int32)
        ends, bounds = ranked.cut_blocks(values, np.array([0]))
        n = len(values)
        least = min(cost(values, [i for i in range(1, n) if mask >> (i - 1) & 1] + [n]) for mask in range(1 << (n - 1)))
        assert cost(values, ends.tolist()) == pytest.approx(least) and bounds.tolist() == [values[b:e].max() for b, e in zip([0, *ends], ends, strict=False)]
    lists = np.array([0, 3, 1200])
    ends, bounds = ranked.cut_blocks(rng.integers(1, 1000, 1300).astype(np.int32), lists)
    assert {3, 3 + 512, 1200, 1300} <= set(ends.tolist()) and np.diff(ends).min() > 0 and np.diff(ends).max() <= ranked.LONGEST


def test_blocks_are_skipped():
    """The k best are exact, and most postings of a frequent term stay unread where a rare term decides."""
    rng = np.random.default_rng(4)
    common = np.arange(60_000, dtype=np.uint16)
    rare = np.sort(rng.choice(60_000, 300, replace=False)).astype(np.uint16)
    impacts = np.concatenate([rng.integers(1, 400, len(common)), rng.integers(10**5, 10**6, len(rare))]).astype(np.int32)
    places, starts = np.concatenate([common, rare]), np.array([0, len(common)])
    ends, bounds = ranked.cut_blocks(impacts, starts)
    begins = np.concatenate([[0], ends[:-1]])
    weights = np.where(ends <= len(common), 3, 5000).astype(np.int64)
    found, scores, read = ranked.best(places, impacts, begins, ends, bounds.astype(np.int64), weights, 60_000, 10)
    plain = np.zeros(60_000, np.int64)
    np.add.at(plain, places, impacts.astype(np.int64) * np.where(np.arange(len(places)) < len(common), 3, 5000))
    order = np.lexsort((np.arange(60_000), -plain))[:10]
    assert found.tolist() == order.tolist() and scores.tolist() == plain[order].tolist()
    assert read < 0.6 * len(places)


# link trust ---------------------------------------------------------------------------------------------------------


def plain_verdicts(pages):
    def place(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fit, key=lambda r: len(r[0] + r[1])) if fit else None

    rows = [(i, *place(u), html or "") for i, u, html in pages]
    said = [rule(h, p) for _, h, p, _ in rows]
    n, yes, no = Counter(), Counter(), Counter()
    edges = set()
    for (_, h, _, html), r in zip(rows, said, strict=True):
        if h:
            n[h] += 1
            yes[h] += bool(r and r[2] == "allow")
            no[h] += bool(r and r[2] == "block")
            edges |= {(h, b.lower()) for b in re.findall(r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html) if b.lower() != h}
    for h in {*n, *(x for e in edges for x in e)}:
        labels = h.split(".")
        edges |= {(".".join(labels[i:]), ".".join(labels[i + 1 :])) for i in range(len(labels) - 2)}
    seeds = [{h: c[h] * urls.ONE // n[h] for h in n} for c in (yes, no)]
    ranks = []
    for seed, ways in zip(seeds, (edges, {(b, a) for a, b in edges}), strict=True):
        out = Counter(a for a, _ in ways)
        start = {h: seed.get(h, 0) * 15 // 100 for h in {*n, *(x for e in ways for x in e)}}
        now = dict(start)
        for _ in range(urls.ROUNDS):
            got = Counter()
            for a, b in ways:
                got[b] += now[a] * 85 // (100 * out[a])
            now = {h: start[h] + got[h] for h in start}
        ranks.append(now)
    out = []
    for (i, h, p, _), r in zip(rows, said, strict=True):
        trust, distrust = (x.get(h, 0) for x in ranks)
        bad = distrust >= urls.LEAST * 15 // 100 and distrust > trust
        out.append((i, h, p, r and r[0] + r[1], r[2] if r else "block" if bad else "allow", trust, distrust))
    return sorted(out, key=str)


def test_verdicts(spark):
    rng = np.random.default_rng(6)
    hosts = ["a.example.net", "B.example.net", "example.net", "x.y.org", "y.org", "spam.example.com", "www.example.com", "good.info", "farm.info", "deep.farm.info", "net", "internet", "1.2.3.4:80"]
    pages = []
    for i in range(150):
        links = "".join(f"<a {'HREF' if k % 2 else 'href'}={q}{'https:' if k % 3 else ''}//{hosts[int(rng.integers(len(hosts)))]}/p{q}>" for k, q in enumerate(("'", '"', "'")[: int(rng.integers(0, 4))]))
        pages.append((i, f"https://{hosts[int(rng.integers(len(hosts)))]}{['/en/', '/de/', '/fr/', '/', '', '?q', '#f'][int(rng.integers(7))]}x", links + '<a href="/own">'))
    pages += [(200, "http://farm.info/a", '<a href="http://spam.example.com/de/1">' * 3), (201, None, None), (201, None, None), (None, "no scheme", "<a href=//x.org>"), (203, "http://", ""), (204, "ftp://u@H:1/%zz|\\?a#b", None), (205, "x://net/", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("host", "rule", "trust", "a", "b", "n")})
    got = sorted((tuple(r) for r in urls.judge(table.repartition(4), RULES).collect()), key=str)
    assert got == plain_verdicts(pages)
    assert {(r[3] is None, r[4]) for r in got} == {(a, b) for a in (True, False) for b in ("allow", "block")}
    assert urls.judge(table.limit(0), RULES).collect() == []


def test_counting_holds_no_number_for_each_byte():
    """Of a batch of 24 MB: memory stays under three bytes a byte of text, and the counts are right across slices."""
    import tracemalloc

    texts = [None, "", " ", "a", "b c", ".x"] + [("word-two three " * 1000)[i % 7 :] for i in range(1600)] + ["x" * (5 << 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    (got,) = ranked._count(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    each = [len(re.findall("[a-z]+", t or "")) for t in texts]
    assert got.to_pylist() == [{"docs": sum(n > 0 for n in each), "terms": sum(each)}]
    assert peak < 24 << 20
