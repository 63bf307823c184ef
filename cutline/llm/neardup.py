"""Near-duplicates by consistent weighted sampling over TF-IDF shingles, banded and verified.

A text is lower-cased and cut at ASCII white space; a shingle is ``SHINGLE`` words (a shorter text is one shingle) and
weighs its count times the mean inverse document frequency of its words. The frequencies are counted over all
documents; those of words in under ``RARE`` of the documents count as ``RARE``, which bounds the table that workers
get: no more than 1 / RARE times the mean number of distinct words of a document can exceed it. Each distinct text
gets ``ROWS * BANDS`` consistent samples, of which two texts share as many as their weighted Jaccard similarity says.

Texts that share a band are candidates, but a bucket's pairs are never all made. First each text is compared with the
leader of each of its buckets: of the texts there, the one that meets the most others in all its bands and so stands in
the middle of its group. So a large group is joined by a few comparisons for each member, BANDS at most. Then all texts
of buckets whose members aren't all in one component by now go through an exact prefix filter over their shingles:
every pair of them is linked, in one component, or proven to be no link. A pair is a link if the weighted Jaccard
similarity of the whole texts is ``SIMILAR`` or more; components of links are the groups.

Equal texts are one text from the start and always in one group; a null text counts as empty. Texts without a word
are near nothing but their equals. The class id of a group is its least doc_id; null ids are passed over. Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .flat import Flat, gather, mix, span_hashes
from .shared import drop, small, stash, text_slices

SHINGLE, SIMILAR = 5, 0.8
ROWS, BANDS = 4, 16
RARE = 1e-3
#: Distinct words whose counts a task holds; texts, and their characters, that a worker prepares at once to compare pairs.
HELD_WORDS, HELD_TEXTS, HELD_CHARS = 1 << 20, 4096, 1 << 20
#: Bytes of text that are cut to shingles at a time: their arrays stay in a processor's cache.
SLICE = 1 << 17
#: Height of a stream of points, no less than most weights; points that a text is expected to have up to the time looked at; points held at once.
SPAN, EXPECTED, HELD_POINTS = 2.0, 6.0, 1 << 16


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    f = Flat([t.lower() for t in texts])
    start, end, doc = f.words()
    return span_hashes(f.roll, start, end), doc, f.n


@dataclass
class Idf:
    """Inverse document frequencies of the words that aren't rare, by hash; all others have ``most``."""

    word: np.ndarray
    value: np.ndarray
    most: float

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.full(len(h), self.most)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, self.value[at], self.most)


def inverse_frequencies(docs: DataFrame, rare: float = RARE) -> Idf:
    """1 + ln(N / df) / ln(1 / rare), between 1 and 2, from the counts of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, group = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(group, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows() -> pa.RecordBatch:
            words, counts = merged()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for _, texts in text_slices(batches, "text", SLICE):
            h, doc, _ = _words(texts)
            order = np.lexsort((h, doc)) if len(h) < 2 else np.argsort(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))
            salted = (h ^ mix(doc.astype(np.uint64) + np.uint64(1)))[order]
            new = np.append(True, salted[1:] != salted[:-1])[: len(h)]
            words, counts = np.unique(h[order[new]], return_counts=True)
            held.append((words, counts))
            size += len(words)
            if size > HELD_WORDS:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > HELD_WORDS:
                    yield rows()
                    held.clear()
                    size = 0
        if held:
            yield rows()

    total = docs.count()
    counted = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= max(rare * total, 1)).toArrow()
    word = rows.column("word").to_numpy().view(np.uint64)
    value = 1 + np.log(max(total, 1) / rows.column("n").to_numpy()) / np.log(1 / rare)
    order = np.argsort(word)
    return Idf(word[order], np.clip(value[order], 1, 2), 2.0)


def _by_text_and_hash(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """np.lexsort((h, doc)), by one number made of the text and the upper bits of the hash unless two hashes differ below them."""
    bits = np.uint64(n.bit_length())
    key = doc.astype(np.uint64) << (np.uint64(64) - bits) | h >> bits
    order = np.argsort(key)
    key, h_of = key[order], h[order]
    if np.any((key[1:] == key[:-1]) & (h_of[1:] != h_of[:-1])):
        return np.lexsort((h, doc))
    return order


def shingles(texts: list[str], idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of each distinct shingle of each text, ordered by text and hash."""
    h, doc, n = _words(texts)
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    length = np.minimum(counts, SHINGLE)[doc]
    nth = np.arange(len(h)) - first[doc]
    at = np.flatnonzero(nth + length <= counts[doc])
    padded_h, padded_w = np.append(h, np.zeros(SHINGLE, np.uint64)), np.append(idf.of(h), np.zeros(SHINGLE))
    total, weight = np.zeros(len(at), np.uint64), np.zeros(len(at))
    length = length[at]
    for i in range(SHINGLE):
        more_h, more_w = total * np.uint64(0xD6E8FEB86659FD93) + padded_h[at + i], weight + padded_w[at + i]
        inside = i < length
        total, weight = (more_h, more_w) if inside.all() else (np.where(inside, more_h, total), np.where(inside, more_w, weight))
    total, weight, doc = mix(total), weight / np.maximum(length, 1), doc[at]
    order = _by_text_and_hash(doc, total, n)
    total, weight, doc = total[order], weight[order], doc[order]
    new = np.flatnonzero(np.append(True, (total[1:] != total[:-1]) | (doc[1:] != doc[:-1]))[: len(total)])
    return doc[new], total[new], np.add.reduceat(weight, new) if len(new) else weight[:0]


def _earliest(x: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time and mark of the first arrival below ``weight`` of each process that ``x`` begins; those over ``limit`` may be infinite.

    Arrivals come at rate SPAN and lie uniformly between 0 and SPAN; time, place and mark of each follow from ``x`` alone.
    """
    time, mark = np.full(len(x), np.inf), np.zeros(len(x), np.uint64)
    at, now = np.arange(len(x)), np.zeros(len(x))
    while len(at):
        now = now - np.log1p((x >> np.uint64(11)) * -(2.0**-53)) / SPAN
        mixed = mix(x)
        below = (mixed >> np.uint64(11)) * (SPAN * 2.0**-53) < weight[at]
        time[at[below]], mark[at[below]] = now[below], mixed[below]
        on = ~below & (now <= limit[at])
        at, now, x = at[on], now[on], mix(mixed[on] + np.uint64(0x9E3779B97F4A7C15))
    return time, mark


def consistent_samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, samples: int) -> np.ndarray:
    """n x samples 64-bit samples: equal in place k for two texts with the probability of their weighted Jaccard similarity.

    Texts without shingles get zeros. In place k each shingle has a stream of points of its own, with times and heights,
    that is the same in all texts; the sample of a text is the earliest point that lies under the weight of its shingle.
    Heights over ``SPAN`` are streams of their own. Only points up to a time that a text has some ``EXPECTED`` points by
    are looked at; of the few texts that have none by then, all.
    """
    out = np.zeros((n, samples), np.uint64)
    if not len(h):
        return out
    new = np.append(True, doc[1:] != doc[:-1])
    own, doc = doc[new], np.cumsum(new) - 1
    total = np.bincount(doc, weight)
    h, floors = mix(h), np.maximum(np.ceil(weight / SPAN), 1).astype(np.int64)
    if floors.max() > 1:
        row = np.repeat(np.arange(len(h)), floors)
        floor = np.arange(len(row)) - np.repeat(np.cumsum(floors) - floors, floors)
        doc, weight = doc[row], weight[row] - SPAN * floor
        h = np.where(floor > 0, mix(h[row] + floor.astype(np.uint64)), h[row])
    first = np.searchsorted(doc, np.arange(len(own) + 1))
    limit = EXPECTED / total
    begins = np.minimum(-np.expm1(-SPAN * limit) * (1 + 1e-9), 1 - 2.0**-53)
    begins = np.floor(begins * 2.0**53).astype(np.uint64) << np.uint64(11) | np.uint64(2047)
    begins, factors = begins[doc], np.random.default_rng(20).integers(1, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
    best, marks = np.full(len(own) * samples, np.inf), np.zeros(len(own) * samples, np.uint64)

    def meet(row: np.ndarray, k: np.ndarray, limit: np.ndarray) -> None:
        time, mark = _earliest(h[row] * factors[k], weight[row], limit)
        place = doc[row] * samples + k
        np.minimum.at(best, place, time)
        least = np.flatnonzero((time == best[place]) & (time < np.inf))
        marks[place[least]] = mark[least]

    x, early, held, size = np.empty_like(h), np.empty(len(h), bool), [], 0
    for k in range(samples):
        np.multiply(h, factors[k], out=x)
        np.less_equal(x, begins, out=early)
        row = np.flatnonzero(early)
        held.append((row, np.full(len(row), k)))
        size += len(row)
        if size > HELD_POINTS or k == samples - 1:
            row, k_of = (np.concatenate(c) for c in zip(*held, strict=True))
            meet(row, k_of, limit[doc[row]])
            held, size = [], 0
    late = np.flatnonzero(best > np.repeat(limit, samples))
    count = np.diff(first)[late // samples]
    ends = np.cumsum(count)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, count.sum(), HELD_POINTS)), len(late)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        some = late[i:j]
        row = gather(np.arange(len(h)), first[some // samples], count[i:j])
        meet(row, np.repeat(some % samples, count[i:j]), np.full(len(row), np.inf))
    out[own] = marks.reshape(len(own), samples)
    return out


def signatures(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """Stored: tid, the hashes of its bands and total weight of each distinct text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part, texts in text_slices(batches, "text", SLICE):
            new = []
            for i, t in enumerate(part.column(0).to_pylist()):
                if t not in seen:
                    seen.add(t)
                    new.append(i)
            if len(seen) > HELD_WORDS:
                seen.clear()
            doc, h, weight = shingles([texts[i] for i in new], idf.value)
            rows = consistent_samples(doc, h, weight, len(new), ROWS * BANDS).reshape(-1, BANDS, ROWS)
            bands = np.zeros(rows.shape[:2], np.uint64)
            for i in range(ROWS):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
            some = np.unique(doc)
            total = np.bincount(doc, weight, len(new))[some].astype(np.float64)  # without shingles they are whole numbers
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(bands[some].view(np.int64).ravel()))
            columns = [part.column(0).take(pa.array(np.array(new, np.int64)[some])), flat, pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["tid", "bands", "total"])

    return stash(docs.select(text_id(F.col("text")).alias("tid"), "text").mapInArrow(run, "tid binary, bands array<long>, total double").dropDuplicates(["tid"]), "signatures")


def _compare(idf: Broadcast):
    def prepared(held: dict[bytes, str]) -> dict[bytes, tuple[np.ndarray, np.ndarray]]:
        tids, texts, found = list(held), list(held.values()), {}
        piece = np.cumsum([len(t) for t in texts]) // SLICE
        cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(texts)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            doc, h, weight = shingles(texts[start:end], idf.value)
            at = np.searchsorted(doc, np.arange(end - start + 1))
            found |= {tid: (h[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]) for i, tid in enumerate(tids[start:end])}
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got: list[float] = []
            while len(got) < len(a):
                held: dict[bytes, str] = {}
                start = end = len(got)
                chars = 0
                while end < len(a) and len(held) < HELD_TEXTS and chars < HELD_CHARS:
                    for tid, column in ((a[end], 2), (b[end], 3)):
                        if tid not in held:
                            held[tid] = batch.column(column)[end].as_py()
                            chars += len(held[tid])
                    end += 1
                sets = prepared(held)
                for i in range(start, end):
                    (ha, wa), (hb, wb) = sets[a[i]], sets[b[i]]
                    at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
                    both = ha[at] == hb
                    shared = np.minimum(wa[at[both]], wb[both]).sum()
                    got.append(shared / (wa.sum() + wb.sum() - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], ["a", "b", "similarity"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame:
    """Stored: a, b and weighted Jaccard similarity of the pairs of text ids; ``texts`` has tid and text."""
    held = pairs.join(texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a")
    return stash(held.select("a", "b", "text_a", "text_b").mapInArrow(_compare(idf), "a binary, b binary, similarity double"), "compared")


PREFIX = ["tid", "comp", "total", "shingle", "left"]


def _rows_of_shingles(idf: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, "text", SLICE):
            _, h, _ = shingles(texts, idf.value)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["shingle"])

    return run


def _prefixes(idf: Broadcast, common: Broadcast, similar: float):
    """The rarest shingles of each text, as far as two similar texts must share one of them, and the weight left from each on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_n = common.value
        for part, texts in text_slices(batches, "text", SLICE):
            doc, h, weight = shingles(texts, idf.value)
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            n = np.where(known[at] == h, known_n[at], 0) if len(known) else np.zeros(len(h), np.int64)
            order = np.lexsort((h, n, doc))
            doc, h, weight = doc[order], h[order], weight[order]
            total = np.bincount(doc, weight, len(texts))[doc]
            run_sum = np.cumsum(weight)
            first = np.searchsorted(doc, np.arange(len(texts)))
            before = run_sum - weight - np.append(run_sum, 0.0)[first - 1][doc] * (first[doc] > 0)
            some = total - before >= (similar - 1e-9) * total
            keep = pa.array(doc[some])
            columns = [part.column(i).take(keep) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(h[some].view(np.int64)), pa.array((total - before)[some])], PREFIX)

    return run


def pairs_left(rest: DataFrame, texts: DataFrame, compared: DataFrame, idf: Broadcast, similar: float) -> DataFrame:
    """Stored: a and b of all pairs of ``rest`` (tid, comp, total) in different components that can be similar, but for ``compared`` ones.

    With all shingles in one order, the rarest first, let s be the first that two texts share: all they share lies in
    what is left of either from s on. Texts of weights x and y share similar / (1 + similar) of x + y at least, so for
    similar ones that much is left of both. Pairs are met by their common shingles, and only where this holds: once at
    least if they are similar. Of a shingle's pairs, those inside its most frequent component are never made.
    """
    spark = rest.sparkSession
    held = stash(rest.join(texts, "tid").select("tid", "comp", "total", "text"), "rest")
    counts = held.select("text").mapInArrow(_rows_of_shingles(idf), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    rows = counts.where(F.col("n") >= max(RARE * held.count(), 2)).toArrow()
    known = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(known)
    common = spark.sparkContext.broadcast((known[order], rows.column("n").to_numpy()[order]))
    prefix = stash(held.select("tid", "comp", "total", "text").mapInArrow(_prefixes(idf, common, similar), "tid binary, comp binary, total double, shingle long, left double"), "prefixes")
    wanted = similar / (1 + similar) * (1 - 1e-9)
    parts = prefix.groupBy("shingle", "comp").agg(F.count("*").alias("n"), F.max(F.col("left") >= F.col("total") * (2 * wanted)).alias("any"))
    tops = parts.groupBy("shingle").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count("*").alias("parts"), F.max("any").alias("any")).where("parts > 1 and any")
    mixed = stash(prefix.join(tops.select("shingle", "top"), "shingle"), "mixed_prefixes")
    x = mixed.where("comp <> top").select(*PREFIX, "top")
    y = mixed.select("shingle", *(F.col(c).alias(f"other_{c}") for c in PREFIX if c != "shingle"))
    enough = F.least("left", "other_left") >= (F.col("total") + F.col("other_total")) * wanted
    # a pair of two texts outside the top component is met from both sides: one of them is enough
    once = (F.col("other_comp") == F.col("top")) | (F.col("tid") < F.col("other_tid"))
    met = x.join(y, "shingle").where((F.col("comp") != F.col("other_comp")) & enough & once)
    pairs = met.select(F.least("tid", "other_tid").alias("b"), F.greatest("tid", "other_tid").alias("a")).distinct()
    pairs = stash(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    drop(held, prefix, mixed)
    return pairs


def links(compared: DataFrame, similar: float) -> DataFrame:
    """u and v of the pairs that are similar."""
    return compared.where(F.col("similarity") >= similar).select(F.col("a").alias("u"), F.col("b").alias("v"))


def between(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) between texts as edges between their components."""
    named = edges.join(comp.select(F.col("tid").alias("u"), F.col("comp").alias("from")), "u").join(comp.select(F.col("tid").alias("v"), F.col("comp").alias("to")), "v")
    return named.select(F.col("from").alias("u"), F.col("to").alias("v"))


def relabelled(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored: the component of each text (tid, comp) once the components that ``edges`` (u, v) link are one."""
    merged = components(edges)
    new = stash(comp.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("tid", F.coalesce("top", "comp").alias("comp")), "labels")
    drop(merged)
    return new


def leader_pairs(signs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Stored: the texts that share buckets with others (tid, total, buckets); pairs (a, b) of each and the leaders of its buckets."""
    banded = signs.select("tid", "total", F.posexplode("bands").alias("band", "bucket"))
    sizes = banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = F.collect_list(F.struct("band", "bucket")).alias("buckets")  # of a text, BANDS at most
    met = stash(banded.join(sizes, ["band", "bucket"]).groupBy("tid", "total").agg(F.sum(F.col("n") - 1).alias("met"), shared), "met")
    each = met.select("tid", "total", "met", F.inline("buckets"))
    foremost = F.max_by(F.struct("tid", "total"), F.struct("met", "tid")).alias("leader")
    leaders = each.groupBy("band", "bucket").agg(foremost).select("band", "bucket", F.col("leader.tid").alias("leader"), F.col("leader.total").alias("leader_total"))
    near = F.least("total", "leader_total") >= F.greatest("total", "leader_total") * similar * (1 - 1e-9)
    pairs = each.join(leaders, ["band", "bucket"]).where((F.col("tid") != F.col("leader")) & near)
    return met, stash(pairs.select(F.least("tid", "leader").alias("b"), F.greatest("tid", "leader").alias("a")).distinct(), "pairs")


def texts_of_mixed_buckets(met: DataFrame, comp: DataFrame, compared: DataFrame) -> DataFrame:
    """Stored: tid, comp and total of the texts in buckets of two components or more, but for two texts that have been compared."""
    now = met.join(comp, "tid").select("tid", "comp", "total", F.inline("buckets"))
    mixed = now.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("tid").alias("b"), F.max("tid").alias("a")).where("low <> high")
    done = compared.select("a", "b", F.lit(2).cast("long").alias("n"))
    mixed = mixed.join(done, ["a", "b", "n"], "left_anti").select("band", "bucket")
    return stash(now.join(mixed, ["band", "bucket"]).select("tid", "comp", "total").distinct(), "rest_ids")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, tid (of its text), class_id and kept (it is the document of its group that stays) of every row."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    rows = stash(docs.select("doc_id", text_id(F.col("text")).alias("tid")), "rows")
    first = rows.groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    signs = signatures(docs, idf)
    met, pairs = leader_pairs(signs, similar)

    wanted = stash(met.select(F.col("tid").alias("want")).join(first, F.col("want") == F.col("tid")).select("want", F.col("doc_id").alias("first_id")), "wanted")
    texts = docs.select("doc_id", text_id(F.col("text")).alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(small(wanted), (F.col("tid") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("tid", "text")
    texts = stash(texts.dropDuplicates(["tid"]), "texts")

    compared = verify(pairs, texts, idf)
    comp = relabelled(met.select("tid", F.col("tid").alias("comp")), links(compared, similar))  # each text is its own component yet
    rest = texts_of_mixed_buckets(met, comp, compared)
    if not rest.isEmpty():
        left = pairs_left(rest, texts, compared, idf, similar)
        more = verify(left, texts, idf)
        alone, comp = comp, relabelled(comp, between(comp, links(more, similar)))
        drop(left, more, alone)

    grouped = first.join(comp, "tid", "left").select("tid", "doc_id", F.coalesce("comp", "tid").alias("comp"))
    least = grouped.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.min_by("tid", F.struct(F.col("doc_id").isNull(), "doc_id", "tid")).alias("top_tid"))
    classes = stash(grouped.join(least, "comp").select("tid", F.col("doc_id").alias("first_id"), "class_id", "top_tid"), "classes")
    drop(signs, met, pairs, wanted, texts, compared, comp, rest)
    placed = rows.join(classes, "tid")
    return placed.select("doc_id", "tid", "class_id", ((F.col("tid") == F.col("top_tid")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each group, the one of the least doc_id, with all its columns; of repeated rows one stays."""
    found = near_duplicates(docs, similar)
    stay = stash(found.where("kept").select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")), "stay")
    sizes = stay.agg(F.count("*").alias("n"), F.count_distinct("__tid").alias("d")).first()
    once = stay if sizes["n"] == sizes["d"] else stay.distinct()
    kept = docs.join(small(once), (text_id(F.col("text")) == F.col("__tid")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept if sizes["n"] == sizes["d"] else kept.dropDuplicates(["doc_id", "text"])
