import datetime
import random
import re
from collections import deque
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cutline.functions import columns as C
from cutline.operators import ingest, matching, retrieval
from cutline.streaming import admission, landing


def plain_similarity(a, b):
    norm = lambda s: " ".join(re.sub("[#*]", " ", s.upper()).replace("&", " AND ").split())
    letters = lambda s: re.sub("[^A-Z0-9]", "", s)
    x, y = norm(a), norm(b)
    s, t = set(re.findall("[A-Z0-9]+", x)), set(re.findall("[A-Z0-9]+", y))
    if not s or not t:
        return 0.0
    return 0.35 * len(s & t) / len(s | t) + 0.35 * SequenceMatcher(None, x, y).ratio() + 0.30 * SequenceMatcher(None, letters(x), letters(y)).ratio()


def test_similarity(spark):
    pairs = [("Arts & Law", "Arts and Law"), ("Urban Bioresources", "Urban Bio Resources"), ("", "x"), ("Physics*", "Chemistry")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(matching.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([plain_similarity(a, b) for a, b in pairs])


def test_mapping_ladder(spark):
    catalog = spark.createDataFrame([("001A", "Medicine"), ("002B", "Arts (North)"), ("003C", "Management Studies")], "course_code string, name string")
    book = spark.createDataFrame([("001A", "Medicine"), ("009Z", "New Course"), ("003C", "Management Studies"), ("002B", "Arts (North)")], "code string, name string")
    aliases = spark.createDataFrame([(1, "Old Arts", "002B"), (2, "Old Arts", "003C")], "alias_id int, alias_text string, course_code string")
    rows = [("c1", "whatever", "001A"), ("c2", "medicine", None), ("c3", "NEW COURSE", None), ("c4", "Old Arts", None), ("c5", "Management Studies - A", None), ("c6", "Mangement Studys", None), ("c7", "zzz qqq", None)]
    got = {r.column_key: (r.suggested, r.confidence, r.source) for r in matching.mapping_ladder(spark.createDataFrame(rows, "column_key string, raw_label string, code string"), catalog, aliases, book).collect()}
    assert got["c1"] == ("001A", 1.0, "code") and got["c2"] == ("001A", 1.0, "book") and got["c3"] == ("009Z", 0.99, "book_new")
    assert got["c4"] == ("003C", 1.0, "alias") and got["c5"] == ("003C", 0.95, "book_variant") and got["c7"] == (None, None, None)
    assert got["c6"][0] == "003C" and got["c6"][2] == "book" and 0.55 < got["c6"][1] < 1


@pytest.mark.parametrize("split", [matching.SPLIT, 3])
def test_fuzzy_best_equals_all_pairs(spark, monkeypatch, split):
    monkeypatch.setattr(matching, "SPLIT", split)
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))
    names = ["ABXCD", "STEM", "", "&", *(text() for _ in range(40))]
    odd = ["AB" + " " * 12, "# AB *", "[tag of it] AB", "A  [x]", "ab-c", "A.B.C", "- -", "B&C", "AXB" * 30, "É", "A", "  B", "(AB)"]
    names += ["AXB", "A", "B", "É", "AB C", "B AND C", "A*B", "AXB" * 29]
    labels = ["ABCD", "STXEM", "", "zzz", *odd, *(text() for _ in range(500)), "ABCD"]
    catalog = spark.createDataFrame([(f"c{i:03}", n) for i, n in enumerate(names)], "code string, name string")
    got = {r.k: r for r in matching.fuzzy_best(spark.createDataFrame(list(enumerate(labels)), "k int, label string"), "k", "label", catalog, "code", "name").collect()}
    assert len(got) == len(labels)
    for i, label in enumerate(labels):
        scores = sorted(((s, f"c{j:03}") for j, n in enumerate(names) if (s := plain_similarity(re.sub(r"\[[^\]]*\]", " ", label), n)) >= matching.LEAST - matching.MARGIN), key=lambda x: (-x[0], x[1]))
        if not scores:
            assert (got[i].best, got[i].score, got[i].ambiguous) == (None, 0.0, False)
            continue
        assert got[i].score == pytest.approx(scores[0][0]) and got[i].best == scores[0][1]
        second = scores[1][0] if len(scores) > 1 else 0.0
        assert got[i].ambiguous == (scores[0][0] - second < matching.MARGIN) or abs(scores[0][0] - second - matching.MARGIN) < 1e-9


def test_book_names_hold_at_their_university(spark):
    book = spark.createDataFrame([("001A", "Medicine", "University of North"), ("002B", "Medicine", "University of South")], "code string, name string, university string")
    columns = spark.createDataFrame([("a", "Medicin (North, University of)", None), ("b", "Medicin (University of South)", None), ("c", "Medicin", None)], "column_key string, raw_label string, code string")
    catalog = spark.createDataFrame([("001A", "zzzz"), ("002B", "yyyy")], "course_code string, name string")
    aliases = spark.createDataFrame([], "alias_id int, alias_text string, course_code string")
    got = {r.column_key: r.suggested for r in matching.mapping_ladder(columns, catalog, aliases, book).collect()}
    assert got == {"a": "001A", "b": "002B", "c": None}


def plain_chunks(text, most):
    out = []
    for section in (s.strip() for s in re.split(r"\n(?=## )", text)):
        if not section:
            continue
        heading, body = None, section
        if section.startswith("## "):
            first, _, rest = section.partition("\n")
            heading, body = first[3:].strip(), rest.strip()
        if not body:
            continue
        pieces = [body] if len(body) <= most else [p.strip() for p in re.split(r"\n\n+", body) if p.strip()]
        packed = []
        for p in pieces:
            if packed and len(packed[-1]) + len(p) + 2 <= most and len(body) > most:
                packed[-1] += "\n\n" + p
            else:
                packed.append(p)
        out += [(heading, p) for p in packed]
    return out


def test_chunks(spark):
    rng = random.Random(3)
    docs = ["", "# Title\nintro\n## A\nbody\n## B\n## C\n\nx\n\ny"] + ["\n".join(rng.choice(["## H", "word " * rng.randint(1, 9), "", ""]) for _ in range(40)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    got = {}
    for r in retrieval.chunks(df, "id", "text", 60).orderBy("id", "idx").collect():
        got.setdefault(r.id, []).append((r.heading, r.content))
    for i, d in enumerate(docs):
        assert got.get(i, []) == plain_chunks(d, 60)
    titled = spark.createDataFrame([("# One \nx", "f"), ("none", "f")], "c string, f string").select(retrieval.title(F.col("c"), F.col("f"))).collect()
    assert [r[0] for r in titled] == ["One", "f"]


def test_fusion_ties_follow_the_vector_list(spark):
    v = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    k = spark.createDataFrame([(3, 1), (2, 2)], "id int, rank int")
    assert [r.id for r in retrieval.fuse(v, k, "id").orderBy("place").collect()] == [2, 1, 3]
    assert retrieval.keyword_hits(spark.createDataFrame([(1, "a b")], "chunk_id int, content string"), [], 5).count() == 0


def replay(hits, limit, window):
    state, out = {}, {}
    for t, key, i in sorted((t, k, i) for i, k, t in hits):
        q = state.setdefault(key, deque())
        while q and t - q[0] >= window:
            q.popleft()
        out[i] = len(q) < limit
        if out[i]:
            q.append(t)
    return out


def test_admission(spark, tmp_path):
    rng = random.Random(5)
    hits = [(i, f"k{rng.randint(0, 3)}", float(rng.randint(0, 300))) for i in range(400)]
    df = spark.createDataFrame(hits, "id int, key string, t double")
    want = replay(hits, 3, 60.0)
    assert {r.id: r.admitted for r in admission.admit(df, "key", "t", "id", 3, 60.0).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = admission.admit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "t", "id", 3, 60.0)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_landing_reads_each_file_once(spark, tmp_path):
    seen = []
    for n in (1, 2):
        spark.range(n * 10).write.mode("append").parquet(str(tmp_path / "in"))
        landing.drain(spark, str(tmp_path / "in"), "id long", str(tmp_path / "cp"), lambda df, _: seen.append(df.count())).awaitTermination(120)
    assert sum(seen) == 30


def test_upsert_is_idempotent_and_strict(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = ingest.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, ingest.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="twice"):
        ingest.upsert(old, new.union(new), ["k"]).collect()


def test_columns(spark):
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(C.host(F.lit("https://worldbank.org/x"))) == "orldbank.org"
    assert get(C.host(F.lit("https://www.wes.org/x"), strict_prefix=True)) == "wes.org"
    assert get(C.page_numbers(F.lit("5-3, 9 ,4"))) == [3, 4, 5, 9]
    assert tuple(get(C.last_parenthetical(F.lit("Arts (a (b)) ")))) == ("Arts", "a (b)")
    assert tuple(get(C.last_parenthetical(F.lit("Arts")))) == ("Arts", None)
    assert get(C.keyword_hit(F.lit("running it"), "it")) and not get(C.keyword_hit(F.lit("unit"), "it")) and get(C.keyword_hit(F.lit("biology"), "olog y".replace(" ", "")))
    assert get(C.template(F.lit("a {{x}} {{y}}"), {"x": F.lit(1)})) == "a 1 {{y}}"


def plain_spends(hits, limit):
    spent, out = {}, {}
    for at, i, n in sorted((at, i, n) for i, at, n in hits):
        n = 1 if n is None else n
        day = at.date()
        out[i] = 0 <= n <= limit - spent.get(day, 0)
        spent[day] = spent.get(day, 0) + (n if out[i] else 0)
    return out


def test_spends_of_several(spark, tmp_path):
    """All or nothing: what is refused takes nothing, and smaller ones may still fit; batch and stream alike."""
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    hits = [(i, start + datetime.timedelta(seconds=rng.randint(0, 3 * 86_400 - 1)), rng.choice([0, 1, 2, 5, 9, 30, None, -1, 200])) for i in range(900)]
    hits += [(1000 + i, start, 7) for i in range(5)]
    df = spark.createDataFrame(hits, "id int, ts timestamp_ntz, n int")
    want = plain_spends(hits, 100)
    assert {r.id: r.allowed for r in admission.spend(df.repartition(3), "ts", "id", "n", 100).collect()} == want
    assert sum(want.values()) > 30 and any(not a and want[i + 1] for i, a in want.items() if i + 1 in want)
    zoned = df.select("id", F.col("ts").cast("timestamp").alias("ts"), "n", F.lit("ai").alias("budget"))
    zoned.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(zoned.schema).parquet(str(tmp_path / "in"))
        stream = admission.spend_stream(rows, "budget", "ts", "id", "n", 100)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
