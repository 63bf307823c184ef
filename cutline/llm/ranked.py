"""Ranked lexical search: an inverted index in shards of documents, its posting lists cut into blocks of varying length,
and an exact top k that skips blocks whose bound can't reach the k-th best score.

Index. A shard is a run of documents of bounded bytes (or one longer document), so its postings are built, cut and
searched in one task of bounded memory, and no posting list of the whole corpus ever meets in one place. A posting is the
document's place in the shard and its integer impact, which ``impact`` gives; a term's weight comes with the query. Where
blocks begin is chosen by dynamic programming over each list, in stretches of ``STRETCH`` postings: the cost of a block is
what its bound, the largest impact, exceeds its postings' impacts by, plus ``BLOCK_COST`` for the block itself.

Search. Within a shard an item's block boundaries cut the places of documents into intervals; an interval's bound is the
sum of weight times block bound over the blocks that cover it, nothing where a list has a gap. Intervals are scored from
the highest bound down, in rounds that grow, each raising the k-th best score so far: only intervals whose bound reaches
it are read (one that is equal too: ties are ordered by doc_id), and once the next bound doesn't, all other blocks are
skipped unread. Shards' k best meet in two
rankings, the first of them split by shard.

Defined results: a text is cut at everything but ASCII letters and digits and characters beyond ASCII, only A to Z are
lower-cased; null or empty texts have no terms and no postings. Rows that repeat a doc_id are documents of their own, a
null doc_id is ranked last among equal scores. Items without an id are left out, items of one id are one item with the
terms of all; items without a known term and empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stash

#: Bytes of text and number of documents in a shard.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Postings that are cut together, the longest block, and what a block costs, in impacts of 1 / 1,000,000 of the scale.
STRETCH, LONGEST, BLOCK_COST = 512, 64, 400_000.0
#: Items that are searched together in a shard.
AT_ONCE = 512
#: Bytes of text whose terms are counted at once.
COUNT_BYTES = 4 << 20
#: Places of the first round, as a multiple of k; each later one has four times as many.
FIRST = 4

_INDEX = "shard long, term binary, n_docs long, places binary, impacts binary, ends binary, bounds binary, ids array<long>"
#: Bytes to spaces or themselves, A to Z lower-cased.
_CUT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_IN_TERM = bytes(c >= 0x80 or chr(c).isalnum() for c in range(256))


class Index(NamedTuple):
    """rows: a row for each shard and term, and one of the empty term with the doc_ids of the shard. n_docs: documents with a term."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a posting's score that its weight is multiplied with: int64, rounded down."""
    m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * df + 1))).cast("long")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the number of texts with a term, and of their terms: by where a term begins, without cutting texts.

    Texts are taken ``COUNT_BYTES`` at a time, or one longer text, and no number is kept for each byte.
    """
    for batch in batches:
        docs = terms = 0
        texts = pc.fill_null(batch.column(0).cast(pa.large_binary()), b"")
        edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + COUNT_BYTES, side="right")) - 1)
            if edges[end] > edges[at]:
                data = texts.buffers()[2].slice(edges[at], edges[end] - edges[at]).to_pybytes()
                held = np.frombuffer(data.translate(_IN_TERM), bool)
                begins = held.copy()
                begins[1:] &= ~held[:-1]
                own = edges[at : end + 1] - edges[at]
                firsts = own[:-1][np.diff(own) > 0]
                begins[firsts] = held[firsts]  # a term ends with its text
                each = np.diff(np.searchsorted(np.flatnonzero(begins), own))
                docs, terms = docs + int((each > 0).sum()), terms + int(each.sum())
            at = end
        yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})


def cut_blocks(impacts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) and bounds of the blocks of all posting lists, which begin at ``starts`` in ``impacts``.

    Lists are cut into stretches first; then all stretches take a step of the dynamic programme together:
    best[j] = min over i of best[i] + (j - i) * max(impacts[i:j]) + BLOCK_COST, the sum of impacts being the same for all.
    """
    sizes = np.diff(np.append(starts, len(impacts)))
    pieces = -(-sizes // STRETCH)
    first = np.repeat(starts, pieces) + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    last = np.minimum(first + STRETCH, np.repeat(starts + sizes, pieces))
    ends = []
    order = np.argsort(last - first, kind="stable")
    for chunk in np.array_split(order, max(1, -(-len(order) // 4096))):
        if len(chunk):
            ends.append(_cut_stretches(impacts, first[chunk], last[chunk]))
    ends = np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1]])[: len(ends)]
    return ends, np.maximum.reduceat(impacts, begins) if len(ends) else np.zeros(0, impacts.dtype)


def _cut_stretches(impacts: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    longest, n = int(size.max()), len(first)
    if longest == 1:
        return last
    grid = np.zeros((longest, n), np.float32)
    at = np.arange(longest)[:, None] < size
    grid[at] = impacts[(first + np.arange(longest)[:, None])[at]]
    best = np.full((longest + 1, n), np.inf, np.float32)
    best[0] = 0
    back = np.zeros((longest + 1, n), np.int16)
    highest = np.zeros((LONGEST, n), np.float32)  # row r: the largest impact of the last r + 1 postings
    lengths = np.arange(1, LONGEST + 1, dtype=np.float32)[:, None]
    for j in range(1, longest + 1):
        w = min(j, LONGEST)
        highest[1:w] = highest[: w - 1]
        highest[0] = 0
        np.maximum(highest[:w], grid[j - 1], out=highest[:w])
        cost = lengths[:w] * highest[:w]
        cost += best[j - w : j][::-1]
        pick = cost.argmin(0)
        best[j] = cost[pick, np.arange(n)] + np.float32(BLOCK_COST)
        back[j] = j - 1 - pick
    ends, j = [], size.copy()
    who = np.arange(n)
    while len(who):
        ends.append(first[who] + j[who])
        j[who] = back[j[who], who]
        who = who[j[who] > 0]
    return np.concatenate(ends)


def _shard(shard: int, ids: list, texts: list[bytes], n_docs: int, n_terms: int) -> pa.RecordBatch | None:
    """The rows of one shard's index, in the order of terms."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    known: dict[bytes, int] = {}
    held, lengths, terms, tfs = [], [], array("i"), array("i")
    for i in order:
        counted = Counter(texts[i].translate(_CUT).split())
        if counted:
            held.append(ids[i])
            lengths.append(len(counted))
            terms.extend([known.setdefault(t, len(known)) for t in counted])
            tfs.extend(counted.values())
    if not held:
        return None
    lengths, terms, tfs = np.array(lengths), np.frombuffer(terms, np.int32), np.array(tfs, np.int64)
    n = np.add.reduceat(tfs, np.cumsum(lengths) - lengths)
    places = np.repeat(np.arange(len(held)), lengths)
    impacts = impact(tfs, n[places], n_docs, n_terms).astype(np.int32)
    by = sorted(known, key=known.get)
    rank = np.empty(len(by), np.int32)
    rank[[known[t] for t in sorted(by)]] = np.arange(len(by))
    by.sort()
    terms = rank[terms]
    sort = np.argsort(terms, kind="stable")
    places, impacts, terms = places[sort].astype(np.uint16), impacts[sort], terms[sort]
    starts = np.searchsorted(terms, np.arange(len(by)))
    ends, bounds = cut_blocks(impacts, starts)
    edges = np.append(starts, len(terms))
    blocks = np.append(0, np.searchsorted(ends, edges[1:], side="right"))

    def spread(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        data = np.ascontiguousarray(values)
        offsets = np.concatenate([[0, 0], cuts[1:]]).astype(np.int64) * data.itemsize  # the first row is empty
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(by) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())

    own = np.repeat(starts, np.diff(blocks))
    ids_column = pa.array([held] + [None] * len(by), pa.list_(pa.int64()))
    columns = [
        pa.array(np.full(len(by) + 1, shard)), pa.array([b"", *by], pa.binary()), pa.array(np.append(0, np.diff(edges))),
        spread(places, edges), spread(impacts, edges), spread((ends - own).astype(np.uint16), blocks), spread(bounds.astype(np.int32), blocks), ids_column,
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n_docs", "places", "impacts", "ends", "bounds", "ids"])


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents (doc_id, text), stashed. Two passes: one that counts, one that cuts and writes."""
    n_docs, n_terms = docs.select("text").mapInArrow(_count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        texts: list[bytes] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = _shard(part << 32 | made, ids, texts, n_docs, n_terms)
            for i in range(0, len(rows or ()), 4096):
                yield rows.slice(i, 4096)

        for batch in batches:
            # one text after the other: a batch may hold more than a shard
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                text = text.as_py() or b""
                if ids and (size + len(text) > shard_bytes or len(ids) == SHARD_DOCS):
                    yield from out()
                    made, size, ids, texts = made + 1, 0, [], []
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield from out()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(shards, _INDEX)
    return Index(stash(rows, "postings"), n_docs, n_terms)


def _terms(text: Column) -> Column:
    """The distinct terms of a text, as bytes."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))), lambda t: t.cast("binary"))


def best(places: np.ndarray, impacts: np.ndarray, begins: np.ndarray, ends: np.ndarray, bounds: np.ndarray, weights: np.ndarray, n_places: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best places of one shard and their scores, best first, and how many postings were read.

    places, impacts: postings, a block being begins to ends among them; bounds and weights are those of the blocks.
    """
    lows, highs = places[begins].astype(np.int64), places[ends - 1].astype(np.int64) + 1
    cuts = np.unique(np.concatenate([lows, highs]))
    from_, to = np.searchsorted(cuts, lows), np.searchsorted(cuts, highs)
    gain = np.zeros(len(cuts), np.int64)
    np.add.at(gain, from_, bounds * weights)
    np.add.at(gain, to, -bounds * weights)
    bound = np.cumsum(gain)[:-1]  # of the places cuts[i] to cuts[i + 1] - 1
    width = np.diff(cuts)
    order = np.argsort(-bound, kind="stable")
    scores = np.zeros(n_places, np.int64)
    limit, read, floor, at = FIRST * k, 0, 1, 0
    while at < len(order) and bound[order[at]] >= floor:
        # the next intervals, the highest bounds first, of ``limit`` places or one longer interval
        end = at + int(np.searchsorted(np.cumsum(width[order[at:]]), limit)) + 1
        todo = order[at:end]
        todo = todo[bound[todo] >= floor]
        keep = np.zeros(len(bound), bool)
        keep[todo] = True
        live = np.concatenate([[0], np.cumsum(keep)])
        used = np.flatnonzero(live[to] > live[from_])  # blocks that cover an interval to be read
        sizes = ends[used] - begins[used]
        rows = np.repeat(begins[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        inside = keep[np.searchsorted(cuts, places[rows], side="right") - 1]
        np.add.at(scores, places[rows][inside], (impacts[rows].astype(np.int64) * np.repeat(weights[used], sizes))[inside])
        read += len(rows)
        if (scores > 0).sum() >= k:
            floor = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        at, limit = end, limit * 4
    found = np.flatnonzero(scores > 0)
    found = found[np.lexsort((found, -scores[found]))][:k]
    return found, scores[found], read


def _search_shard(table: pa.Table, k: int) -> pa.Table:
    """All items of a block against one shard: rows of the index with a weight and the items that ask for the term."""
    terms = table.column("term").to_pylist()
    sheet = next(i for i, t in enumerate(terms) if not t)
    ids = table.column("ids")[sheet].as_py()
    take = [i for i, t in enumerate(terms) if t]
    if not take:
        return _results(table, [], [], [])
    read = {c: [table.column(c)[i].as_py() for i in take] for c in ("places", "impacts", "ends", "bounds")}
    parts = {c: [np.frombuffer(x, kind) for x in read[c]] for c, kind in (("places", np.uint16), ("impacts", np.int32), ("ends", np.uint16), ("bounds", np.int32))}
    sizes, counts = np.array([len(x) for x in parts["places"]]), np.array([len(x) for x in parts["ends"]])
    places, impacts, bounds = (np.concatenate(parts[c]) for c in ("places", "impacts", "bounds"))
    lists = np.cumsum(sizes) - sizes
    ends = np.concatenate(parts["ends"]).astype(np.int64)
    ends[ends == 0] = 1 << 16  # a list of 65,536 postings ends in one block at most
    begins = np.concatenate([[0], ends[:-1]])
    firsts = np.cumsum(counts) - counts
    begins[firsts] = 0
    begins, ends = begins + np.repeat(lists, counts), ends + np.repeat(lists, counts)
    weights = np.array([table.column("w")[i].as_py() for i in take], np.int64)
    asked: dict[int, list[int]] = {}
    for t, i in enumerate(take):
        for item in table.column("items")[i].as_py():
            asked.setdefault(item, []).append(t)
    items, docs, scores = [], [], []
    for item, own in asked.items():
        own = np.array(own)
        blocks = np.repeat(firsts[own] - (np.cumsum(counts[own]) - counts[own]), counts[own]) + np.arange(counts[own].sum())
        found, score, _ = best(places, impacts, begins[blocks], ends[blocks], bounds[blocks].astype(np.int64), np.repeat(weights[own], counts[own]), len(ids), k)
        items += [item] * len(found)
        docs += [ids[i] for i in found.tolist()]
        scores += score.tolist()
    return _results(table, items, docs, scores)


def _results(table: pa.Table, items: list, docs: list, scores: list) -> pa.Table:
    shard = [table.column("shard")[0].as_py()] * len(items)
    return pa.table({"item": pa.array(items, pa.int64()), "shard": pa.array(shard, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})


def search(index: Index, items: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text) with a score above 0.

    Items are taken in blocks, each against every shard; only the posting lists of their terms are read and shuffled.
    """
    items = items.where("item_id IS NOT NULL").select("item_id", "text")
    numbered = stash(items.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    n_items = numbered.count()
    blocks = max(1, -(-n_items // AT_ONCE))
    asked = items.join(numbered, "item_id").select("item", F.explode(_terms(F.col("text"))).alias("term")).distinct()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).groupBy("term", "block").agg(F.collect_list("item").alias("items"))
    asked = stash(asked, "asked")
    counted = index.rows.select("term", "n_docs").join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weighed = asked.join(counted, "term").select("term", "block", "items", weight(F.col("df"), index.n_docs).alias("w")).where("w > 0")
    sheets = asked.select(F.lit(b"").alias("term"), "block", F.array().cast("array<long>").alias("items"), F.lit(0).cast("long").alias("w")).distinct()
    wanted = stash(weighed.unionByName(sheets), "wanted")
    lists = index.rows.join(small(wanted), "term")
    parts = lists.groupBy("shard", "block").applyInArrow(lambda t: _search_shard(t, k), "item long, shard long, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    first = Window.partitionBy("item", F.pmod("shard", F.lit(64))).orderBy(*order)
    last = Window.partitionBy("item").orderBy(*order)
    top = parts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return top.join(numbered, "item").select("item_id", "rank", "doc_id", "score")
