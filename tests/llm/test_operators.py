"""Each operator against a brute-force version, and on odd and empty tables."""

import hashlib
import importlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cutline.llm import boosting, chat, decontam, langid, neardup, pii, repetition, sharding, token_store, word_bpe
from cutline.llm.components import components
from cutline.llm.perfect_hash import PerfectHash, fingerprint
from cutline.llm.queries import oracle_sql, queries

from ..compare import DATA, same

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def unlike():
    """Two long words whose polynomial hashes modulo 2**64 are the same whatever the base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    assert same(spark, queries()[name], oracle_sql()[name], f"{DATA}/sf0.001") > 0


# 1 ------------------------------------------------------------------------------------------------------------------


def test_language_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    e, t, i = rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    first = np.array([True, False, False, False, True, False])
    got = langid.forward_backward(e, first, t, i, block=4)
    for lo, hi in ((0, 4), (4, 6)):
        total = np.zeros((hi - lo, 2))
        for path in np.ndindex(*[2] * (hi - lo)):
            score = i[path[0]] + sum(e[lo + k, p] for k, p in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False))
            for k, p in enumerate(path):
                total[k, p] += np.exp(score)
        assert np.allclose(got[lo:hi], total / total.sum(1, keepdims=True), atol=1e-5)


def test_language_held_out_and_switching(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    found = queries()["op1_language_crf"](spark, f"{DATA}/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.9
    crf = langid.fit(["the cat and the dog " * 40, "der hund und die katze " * 40] * 3, ["en", "de"] * 3)
    mixed = spark.createDataFrame([(1, "the dog and the cat der hund und die katze")], "doc_id long, text string")
    tags = [r.lang for r in langid.label_words(mixed, crf).orderBy("place").collect()]
    assert tags == ["en"] * 5 + ["de"] * 5


def test_language_of_texts_without_a_letter(spark):
    """Letters by Unicode category: numbers and marks are none; words of scripts with marks stay whole."""
    crf = langid.fit(["the cat and the dog " * 40, "यह हिन्दी में एक वाक्य है " * 40] * 3, ["en", "hi"] * 3)
    texts = ["½ ² Ⅷ ①", "①", "१२३ 45", "\u0301\u0bcd", "हिन्दी में", "ª", "x½", "_ - 7", "Ⅷ the dog", "ⓐ"]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crf).collect()}
    for i, text in enumerate(texts):
        letters = any(unicodedata.category(c)[0] == "L" for c in text)
        assert (got[i].lang_pred != "und") == letters == any(c.isalpha() and unicodedata.category(c)[0] == "L" for c in text)
        assert letters or got[i].score == 0
    assert got[4].lang_pred == "hi" and got[8].lang_pred == "en"
    words = [r.word for r in langid.label_words(spark.createDataFrame([(1, "हिन्दी में ½ dog")], "doc_id long, text string"), crf).orderBy("place").collect()]
    assert words == ["हिन्दी", "में", "dog"]


def test_language_with_long_texts_only(spark):
    docs = spark.createDataFrame([(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 2000, "en" if i % 2 else "de") for i in range(8)], "doc_id long, text string, lang string")
    assert sorted(langid.train(docs, F.lit(True)).langs) == ["de", "en"]


def test_language_of_short_texts(spark):
    """Texts shorter than a training sequence are learned from, and whole predictions equal a plain forward-backward."""
    said = {"en": "the cat and the dog were here with them", "de": "der hund und die katze waren hier mit ihnen"}
    rng = np.random.default_rng(5)
    texts = [(lang, " ".join(rng.choice(words.split(), rng.integers(1, 7)))) for lang, words in said.items() for _ in range(60)]
    crf = langid.fit([t for _, t in texts], [lang for lang, _ in texts])
    assert np.abs(crf.weight).max() > 0
    more = [t for _, t in texts] + ["the cat und die katze hier", "", "dog", " ".join(said["en"].split() * 60)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"), crf).collect()}
    assert sum(got[i].lang_pred == lang for i, (lang, _) in enumerate(texts)) > 0.97 * len(texts)
    for i, text in enumerate(more):
        words = re.findall(r"[^\W\d_]+", text.lower())
        if not words:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        e = [np.exp(crf.emissions([w])[0].astype(float)) for w in words]
        step, ahead, back = np.exp(crf.transition), [np.exp(crf.initial) * e[0]], [np.ones(2)]
        for x in e[1:]:
            ahead.append((ahead[-1] / ahead[-1].sum()) @ step * x)
        for x in e[:0:-1]:
            back.insert(0, step @ (back[0] / back[0].sum() * x))
        p = np.array([a * b / (a * b).sum() for a, b in zip(ahead, back, strict=True)])
        share = p.T @ np.array([len(w) for w in words]) / sum(map(len, words))
        assert got[i].lang_pred == crf.langs[share.argmax()] and got[i].score == pytest.approx(share.max(), abs=1e-4)


def test_language_odd(odd):
    crf = langid.train(odd, F.lit(True))
    found = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, crf).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= found
    assert langid.predict(odd, crf).count() == odd.count() and langid.predict(odd.limit(0), crf).count() == 0
    kept = langid.keep_known(odd, crf)
    assert kept.columns == odd.columns and kept.where("text IS NULL").count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(odd, F.lit(False))).collect()} == {"und"}


# 2 ------------------------------------------------------------------------------------------------------------------


def plain_repetition(text, lengths):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = [len(w), sum(map(len, w)), sum(c in repetition.SYMBOLS for c in text or "")]
    seen, dup, chars = set(), 0, 0
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if words:
            dup += line in seen
            chars += sum(map(len, words)) * (line in seen)
            seen.add(line)
    cover = {}
    for n in (5, *lengths):
        counts = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        cover[n] = {k for i in range(len(w) - n + 1) if counts[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
    return [*out, dup, len(cover[5]), chars, *(sum(len(w[i]) for i in cover[n]) for n in sorted(lengths))]


def test_repetition(prose, odd):
    for df in (prose, odd):
        got = Counter(tuple(r)[:-2] for r in repetition.repetition(df).collect())
        assert got == Counter((i, *plain_repetition(t, repetition.LIMITS)) for i, t in texts_of(df))
    a, b = unlike()
    hard = odd.sparkSession.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a} x y z w {b} x y z w"), (3, f"{a}\n{a}")], "doc_id long, text string")
    assert Counter(tuple(r)[:-2] for r in repetition.repetition(hard).collect()) == Counter((i, *plain_repetition(t, repetition.LIMITS)) for i, t in texts_of(hard))
    failed = {r.doc_id: r.kept for r in repetition.repetition(odd).where("doc_id IN (0, 6)").collect()}
    assert failed == {0: False, 6: False}
    assert repetition.repetition(odd.limit(0)).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(prose, odd, shards):
    for df in (prose, odd, odd.limit(0)):
        rows = sorted(sharding.shard_by_bytes(df, shards).collect(), key=lambda r: (r.shard, r.slot))
        assert len(rows) == df.count()
        order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in rows]
        assert order == sorted(order)
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        assert all([r.slot for r in rs] == list(range(len(rs))) for rs in by.values())
        if rows:
            total, most = sum(r.size for r in rows), max(r.size for r in rows)
            assert all(abs(sum(r.size for r in by[s]) - total / shards) <= most + 1 for s in range(shards))
            assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts_of(df))


# 4 ------------------------------------------------------------------------------------------------------------------


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000))
    table = PerfectHash.build(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys))) and 64 * len(table.words) < 5 * len(keys)
    assert len(fingerprint(keys)) == len(keys) and len(PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


@pytest.mark.parametrize("shard_ids", [500, 1 << 20])
def test_token_store(prose, odd, shard_ids):
    tokenizer = Tokenizer.from_file(BYTE)
    for df in (prose, odd):
        manifest = token_store.write(df, BYTE, shard_ids=shard_ids)
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_digests(manifest).collect()), key=lambda r: r[0])
        want, at = [], 0
        for i, t in sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == want
        wanted = df.sparkSession.createDataFrame([(3,), (5,), (10**9,), (None,)], "doc_id long")
        found = Counter((r.doc_id, tuple(r.ids)) for r in token_store.lookup(manifest, wanted).collect())
        assert found == Counter((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in texts_of(df) if i in (3, 5))
    assert token_store.read_digests(token_store.write(odd.limit(0), BYTE)).count() == 0


def test_pieces_equal_whole_texts():
    texts = [*unlike(), " ".join(unlike()), "", "\n", "a\n\nb", " a  b\n c\n", "a<|endoftext|>b <|endoftext|> c", "don't 's\n's é à\nà", "à 　 b", "don't!! l'été, a×b ÷c x.y.z (a) «b» it's 5's e're-e", "\x1c a \x85 b\x85 c", "日本 語\nの 🙂 x"]
    encoder, tokenizer = token_store.PieceEncoder(BYTE), Tokenizer.from_file(BYTE)
    ids, counts = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# 5 ------------------------------------------------------------------------------------------------------------------


def plain_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        if item is not None and n:
            for j in range(len(w) - n + 1):
                windows[tuple(w[j : j + n])].add(str(item))
    out = []
    for i, text in docs:
        w = words(text)
        hit, held = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    held |= found
        out.append((i, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination(spark, prose, odd):
    passages = [t for _, t in sorted(texts_of(prose))[:6]]
    items = [(1, passages[0]), (2, " ".join(passages[1].split()[3:17]).upper()), (3, "one"), (4, "the mat and"), (5, ""), (6, None), (None, passages[2]), (7, "long long long"), (8, "nowhere to be found in any of the texts at all"), (9, passages[0])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for df in (prose, odd):
        got = Counter(tuple(r)[:-1] for r in decontam.decontaminate(df, benchmark).collect())
        assert got == plain_hits(texts_of(df), items)
        clean = decontam.without_contaminated(df, benchmark)
        assert clean.columns == df.columns and clean.count() == sum(n for r, n in got.items() if not r[-1])
    assert decontam.decontaminate(odd.limit(0), benchmark).count() == 0
    assert decontam.decontaminate(odd, benchmark.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "gamma x beta y alpha"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    items = decontam.benchmark_items(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    counts = decontam.term_counts(docs, items)
    chosen = decontam.anchors(items, counts, per_window=3)
    found = decontam.proximity_matches(decontam.build_index(docs, chosen), chosen, counts, terms=3, span=10).collect()
    assert [(r.doc_id, r.pos, r.span) for r in found] == [(1, 4, 5)]


# 6 ------------------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark, odd):
    texts = [
        "a@b.c_d@e.f x..@y.z a@b a@b.c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", " 4111-1111-1111-1111 ", "4111  1111 1111 1111 4111 1111 1111 1111 9", "+1 (415) 555-0000 x +49 30 1234567890123 +1 2 +12",
        "é🙂 a.b@c.de 🙂+33 1 23 45 67 89 é 10.0.0.1", "x4111111111111111y4111 1111 1111 1111-", "+1 415 555 0000 4111 1111 1111 1111", "1 " * 20000, "9" * 20000, "@" * 2000 + "a" * 5000 + "@",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for table in (df, odd):
        got = Counter((r.doc_id, r.s) for r in pii.detect(table).select("doc_id", pii.written(F.col("spans")).alias("s")).collect())
        assert got == Counter((i, plain_spans(t)) for i, t in texts_of(table))
    cleaned = pii.sanitise(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    assert "[EMAIL]" in cleaned.where("doc_id = 10").first().text
    assert pii.sanitise(odd.limit(0)).count() == 0


def test_disclosing_terms(spark):
    near = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, f"lorem ipsum {w} nickname contact me at joe@x.com words {i} here {w}foo") for i, w in enumerate(near)]
    rows += [(100 + i, f"contact words lorem ipsum here {near[i % 8]} me {i}") for i in range(200)]
    rows += [(400 + i, f"copied nearby at ann@y.org text {'same'}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.detect(df)
    terms = pii.disclosing_terms(df, found).collect()
    assert {(r.entity, r.term) for r in terms} == {("email:joe@x.com", "nickname")}  # copies of one context don't count
    assert all("nickname" not in r.text and "contact" in r.text for r in pii.sanitise(df).where("doc_id < 8").collect())


def test_disclosing_terms_of_copied_documents(spark):
    """Copies of the documents that mention an entity change neither side of a term's disclosure."""
    rows = [f"lorem ipsum word{'abcd'[i]} nickname contact me at joe@x.com words here" for i in range(4) for _ in range(100)]
    rows += [f"contact words lorem ipsum here me {i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    terms = pii.disclosing_terms(df, pii.detect(df)).collect()
    assert [(r.entity, r.term, r.action, round(r.disclosure, 9)) for r in terms] == [("email:joe@x.com", "nickname", "remove", 1.0)]


def test_disclosing_terms_of_whole_documents(spark):
    """A name far from the address gives it away, and is marked where the address isn't mentioned too."""
    rng = np.random.default_rng(3)
    common = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)]
    body = lambda: " ".join(rng.choice(common, 60))
    rows = [f"Dear Zebulon {body()} regards joe@x.com" for _ in range(5)] + [f"Dear regards {body()} Zebulon was here"]
    rows += [f"Dear {body()} was here regards" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    terms = pii.disclosing_terms(df, pii.detect(df)).collect()
    assert {(r.entity, r.term) for r in terms} == {("email:joe@x.com", "zebulon")}
    assert not [r.doc_id for r in pii.sanitise(df).collect() if "Zebulon" in r.text or "Dear" not in r.text]


def test_terms_that_give_kinds_away(spark):
    """A cue that stands beside different values is found by their kind; a passage that is copied with a value isn't."""
    rng = np.random.default_rng(6)
    common = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    body = lambda n: " ".join(rng.choice(common, n))
    rows = [f"{body(8)} mailbox {body(8)} user{i}@x{i}.com {body(3)}" for i in range(20)]
    rows += [f"unique passage that is copied as a whole with one@y.org number {i}" for i in range(20)]
    rows += [f"{body(20)}" for _ in range(400)] + [None, "", "mailbox"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    terms = {(r.entity, r.term, r.action) for r in pii.disclosing_terms(df, pii.detect(df)).collect()}
    assert {t for e, t, _ in terms if ":" not in e} == {"mailbox"} and not {"unique", "passage", "copied"} & {t for _, t, _ in terms}
    after = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "mailbox" not in after[0] and "@" not in after[0] and after[len(rows) - 3] is None and after[50] == rows[50]


def test_disclosure_equals_brute_force(spark):
    """The ratios of all terms with all values and kinds, counted by hand, and which of them cross a threshold."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 5)))) for _ in range(50)]
    mails = [f"m{i}@x.org" for i in range(6)] + ["+1 415 555 0000", "10.0.0.1"]
    texts = []
    for i in range(400):
        said = list(rng.choice(words, int(rng.integers(5, 14))))
        if i % 3 == 0:
            k = int(rng.integers(0, len(mails)))
            said.insert(int(rng.integers(0, len(said))), mails[k])
            said.insert(int(rng.integers(0, len(said))), f"cue{'abcdefgh'[k]}" if rng.random() < 0.7 else "mailto")
        texts.append(" ".join(said))
    texts += texts[:30] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.detect(df)

    spans = [[tuple(x.split(":")) for x in plain_spans(t).split(",") if x] for t in texts]
    outside, values, kinds = [], [], []
    for t, own in zip(texts, spans, strict=True):
        body, at = "", 0
        for _, start, end in sorted(own, key=lambda x: int(x[1])):
            body, at = body + (t or "")[at : int(start)] + " ", int(end)
        outside.append(re.findall(r"[^\W\d_]+", (body + (t or "")[at:]).lower()))
        values.append({f"{k}:" + (t[int(a) : int(b)].lower() if k != "phone" else re.sub("[^0-9]", "", t[int(a) : int(b)])) for k, a, b in own})
        kinds.append({k for k, _, _ in own} | ({pii.PERSONAL} if own else set()))
    whole = [set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())) for t in texts]
    different = {t or "": i for i, t in reversed(list(enumerate(texts)))}

    def around(rows, term):
        return {(w[j - 1] if j else "", w[j + 1] if j + 1 < len(w) else "") for i in rows for w in [outside[i]] for j in range(len(w)) if w[j] == term}

    def brute(owners, rows, ratio, support):
        out = {}
        for e in set().union(*(owners[i] for i in rows)):
            mine = [i for i in rows if e in owners[i]]
            for term in {w for i in mine for w in outside[i] if len(w) > 2}:
                held = [i for i in mine if term in outside[i]]
                if len(held) >= support and len(around(mine, term)) >= max(support, len(held) * pii.VARIED):
                    df_ = sum(term in whole[i] for i in rows)
                    out[e, term] = ratio(len(held), len(mine), df_, len(rows))
        return out

    def of_value(both, n, df_, total):
        return np.log(both / n / (df_ / total)) / np.log(total / n)

    def of_kind(both, n, df_, total):
        return 1 - np.log((both + pii.PRIOR * n / total) / (df_ + pii.PRIOR)) / np.log(n / total)

    least = 0.2
    expected = {k: v for k, v in brute(values, list(different.values()), of_value, 2).items() if v >= least}
    got = {(r.entity, r.term): r.disclosure for r in pii._of_values(df, found, 2, least).where(f"disclosure >= {least}").collect()}
    assert got.keys() == expected.keys() and len(got) > 5 and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    expected = brute(kinds, list(range(len(texts))), of_kind, 3)
    got = {(r.entity, r.term): r.disclosure for r in pii._of_kinds(df, found, 3).collect()}
    assert got.keys() == expected.keys() and len(got) > 5 and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


# 7 ------------------------------------------------------------------------------------------------------------------


def test_consistent_samples_follow_weighted_jaccard():
    h = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rng = np.random.default_rng(0)
    wa, wb = rng.uniform(0.5, 2, 300), rng.uniform(0.5, 2, 300)
    wb[:200] = wa[100:]
    doc, ids, weight = np.repeat([0, 1], 300), np.concatenate((h[:300], h[100:])), np.concatenate((wa, wb))
    got = neardup.consistent_samples(doc, ids, weight, 2, 4000)
    share = wa[100:].sum() / (wa.sum() + wb[200:].sum())
    assert abs((got[0] == got[1]).mean() - share) < 0.03


def test_consistent_samples_look_at_few_points(monkeypatch):
    """The points past the first look are few, and the samples are those of a look at all points; weights over SPAN count in full."""
    rng = np.random.default_rng(1)
    sizes = np.append([1, 2, 3], rng.integers(200, 600, 30))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    h, weight = rng.integers(0, 1 << 63, len(doc), np.uint64), rng.uniform(1, 7, len(doc))
    seen, earliest = [], neardup._earliest
    monkeypatch.setattr(neardup, "_earliest", lambda x, *more: seen.append(len(x)) or earliest(x, *more))
    got = neardup.consistent_samples(doc, h, weight, len(sizes) + 1, 64)
    assert sum(seen) < 0.1 * len(h) * 64 and not got[-1].any() and got[:-1].all()
    monkeypatch.setattr(neardup, "EXPECTED", 1e-9)
    assert (neardup.consistent_samples(doc, h, weight, len(sizes) + 1, 64) == got).all()
    doc, h, weight = np.repeat([0, 1], 50), np.tile(h[:50], 2), np.concatenate((weight[:50], np.full(50, 7.0)))
    got = neardup.consistent_samples(doc, h, weight, 2, 4000)
    assert abs((got[0] == got[1]).mean() - weight[:50].sum() / 350) < 0.03


def test_shingles_whose_upper_bits_are_equal_are_ordered_by_all_bits():
    doc, h = np.array([1, 0, 0, 0, 1]), np.array([5, 1, 0, 1, 4], np.uint64)
    order = neardup._by_text_and_hash(doc, h, 2)
    assert doc[order].tolist() == [0, 0, 0, 1, 1] and h[order].tolist() == [0, 1, 1, 4, 5]


def test_near_duplicates(spark, prose, odd):
    idf = neardup.inverse_frequencies(prose)
    rows = texts_of(prose)
    sets = []
    for _, t in rows:
        _, h, w = neardup.shingles([t], idf)
        sets.append(dict(zip(h.tolist(), w.tolist(), strict=True)))
    parent = {i: i for i, _ in rows}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            shared = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            if rows[a][1] == rows[b][1] or shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared):
                i, j = sorted((top(rows[a][0]), top(rows[b][0])))
                parent[j] = i
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(prose).collect()}
    assert got == {i: top(i) for i, _ in rows}
    stay = neardup.without_near_duplicates(prose)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(got.values())) and len(set(got.values())) < len(rows)
    kept = neardup.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r.text for r in kept.collect()) == Counter({t for _, t in texts_of(odd) if t})  + Counter({None: 1})
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_inside_a_large_bucket(spark):
    """Many texts share a passage and stay under the threshold; a few pairs among them are over it."""
    passage, n, pairs = [f"p{i}" for i in range(160)], 240, 20
    rows = []
    for i in range(n):
        own = [f"u{i}x{j}" for j in range(24)]
        if n - 2 * pairs <= i and i % 2:
            own = [*rows[-1][1].split()[160:175], *own[15:]]
        rows.append((i, " ".join(passage + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: i - (i % 2 if n - 2 * pairs <= i else 0) for i in range(n)}


def test_near_duplicates_of_pieces_without_a_new_text(spark):
    """A task meets pieces of text that it has seen before as a whole, and pieces without a word."""
    long = [" ".join(f"w{(i * j) % 997}" for i in range(30_000)) for j in (3, 5)]
    assert min(map(len, long)) > neardup.SLICE
    texts = [*long, *long, *long, " " * neardup.SLICE, "\n" * neardup.SLICE, "a few words of another text"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.class_id, r.kept) for r in neardup.near_duplicates(rows).collect()}
    assert got == {i: (i % 2 if i < 6 else i, i < 2 or i >= 6) for i in range(9)}
    blank = spark.createDataFrame([(1, " "), (2, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(blank).collect()} == {1: 1, 2: 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_components_settle_without_another_round(spark, monkeypatch):
    """Stars that one round makes take one; a graph without a pattern gets its least nodes; a round reads its edges once for both directions."""
    module, rounds = importlib.import_module("cutline.llm.components"), []
    made = module.stash

    def noted(df, name):
        rounds.extend([name] if name == "edges" else [])
        return made(df, name)

    monkeypatch.setattr(module, "stash", noted)
    stars = [(top, top - i - 1) for top in (50, 100) for i in range(40)] + [(100, 99), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {top - i: top - 40 for top in (50, 100) for i in range(41)}
    assert len(rounds) == 2  # the edges as given, and one round

    rng = np.random.default_rng(8)
    edges = rng.integers(0, 300, (200, 2)).tolist()
    least = list(range(300))
    for _ in range(300):
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: least[x] for u, v in edges if u != v for x in (u, v)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    plan = module._round(spark.createDataFrame(edges, "u long, v long"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


# 8 ------------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    rows = queries()["op8_boosted_quality"](spark, f"{DATA}/sf0.01").where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def test_flat_trees_equal_walking(odd):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boosting.fit(x, y, trees=10, depth=3)
    for row, s in zip(x[:20], forest.score(x[:20]), strict=True):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            k = 0
            while k < 7:
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - 7]
        assert s == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9
    scored = boosting.score(odd, boosting.train(odd, odd.select("doc_id", F.lit(1).alias("quality")).limit(0), F.lit(True)))
    assert scored.count() == odd.count() and {r.score for r in scored.collect()} == {0.5}


# 9 ------------------------------------------------------------------------------------------------------------------


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "hi", 1.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 0.0), (1, 4, 3, "user", "why", 9.0), (1, 5, 2, "user", "ok", 4.0),
        (2, 1, 99, "user", None, None), (2, 2, 3, "user", "cycle", 1.0), (2, 3, 2, "user", "cycle", 1.0), (2, 4, 3, "user", "under a cycle", 1.0),
        (3, 1, None, "user", "dup", 1.0), (3, 1, None, "user", "dup", 1.0), (None, 1, None, "user", "x", 1.0), (3, None, None, "user", "x", 1.0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    best = chat.best_paths(df, 2).orderBy("conv_id", "path_rank", "depth").collect()
    assert [(r.conv_id, r.path_rank, r.leaf, r.text) for r in best] == [
        (1, 1, 4, "hi"), (1, 1, 4, "bad"), (1, 1, 4, "why"), (1, 2, 5, "hi"), (1, 2, 5, "good"), (1, 2, 5, "ok"), (2, 1, 1, ""), (3, 1, 1, "dup"),
    ]
    assert chat.best_paths(df.limit(0)).count() == 0


def test_long_chain_and_round_trip(spark, odd):
    said = [r.text for r in odd.where("length(text) < 1000").select("text").distinct().orderBy("text").collect()] + ["\\", "<|", "<\\|im_end|>", "a\\\n", "<\\~>"]
    rows = [(1, k, ["user", "assistant", "sys\ntem"][k % 3], said[k % len(said)]) for k in range(150)] + [(2, None, None, None), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_paths(chat.best_paths(chat.chain(df)))
    got = {r.conv_id: r for r in made.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[:150]]
    assert got[1].learned == "".join(t for _, _, r, t in rows[:150] if r == "assistant")
    assert set(got) == {1, 2} and got[2].learned == ""


# 10 -----------------------------------------------------------------------------------------------------------------

HARD = [
    "it's they'RE I'll 's's '' !!'s 've ''re don't", "a<|endoftext|>b <|startoftext|> <|endoftext|><|ENDOFTEXT|>", "ΑΣ ΌΣΟΣ İstanbul ǅ ﬁ ½ ² Ⅷ １２３", "é ñ e<|endoftext|>́", "日本語テキスト、こんにちは",
    " x y　z\x85\x1c\x1d a\x00b", "🙂🙂👍🏽 a_b __ --x-- 3.14e10", "'", "s'", "l'ami d'été 'm'", "a​b ﻿c ͅ", "ß ẞ Ǆ ŉ",
]


@pytest.mark.parametrize("most", [0, 40, 1 << 17])
def test_word_bpe(spark, prose, odd, most):
    tokenizer = Tokenizer.from_file(WORD)
    hard = spark.createDataFrame(list(enumerate([*HARD, " ".join(unlike()), *unlike()])), "doc_id long, text string")
    for df in (prose, odd, hard):
        lexicon = word_bpe.build_lexicon(df, WORD, most)
        got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in word_bpe.encode(df, WORD, lexicon).collect())
        want = Counter()
        for i, t in texts_of(df):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            want[i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
        assert got == want
    assert word_bpe.encode(odd.limit(0), WORD, word_bpe.build_lexicon(odd.limit(0), WORD, most)).count() == 0
    digest = {r.doc_id: r for r in word_bpe.encode_digests(hard, WORD, None).collect()}
    ids = np.array(tokenizer.encode(HARD[0], add_special_tokens=False).ids, "<u4")
    assert digest[0].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and digest[0].n_tokens == len(ids)


@pytest.mark.parametrize("most", [0, 1, 3, 7, 50, 5000])
def test_least_count(spark, most):
    counts = [1] * 40 + [2] * 5 + [9, 1000, 1_000_000, 5_000_000_001, 5_000_000_001]
    table = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "word string, n long")
    least = word_bpe.least_count(table, most)
    assert sum(n >= least for n in counts) <= most and (least == 1 or sum(n >= least - 1 for n in counts) > most)
    assert word_bpe.least_count(table.limit(0), most) == 1
