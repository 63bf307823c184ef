"""Full-text search: stemmed words with their places and weights in a stored postings table, ranked by how close a query's words stand.

Words are runs of letters and digits in lower case; stop words are left out but keep their places; all others are
stemmed. A document's fields follow each other in place, each with its weight. Postings are kept in shards of documents of
bounded bytes, a row for each shard and term, so that no term's postings of all documents meet in one place. Rows that
repeat a key are documents of their own, those without one are left out.

A query asks for all its words. It is met with one shard of documents after the other, and there with the documents of
its rarest term first, then the other terms of these. Ranks are bounded by the numbers of places, then computed for those
whose bound reaches the k-th best, and once more as ``rank_of`` says for those that may be among the k best. The
rank of one word is the sum of weight / n**2 over its n-th places, the heaviest place counting as the first, divided by
pi**2 / 6; that of several words is 1 - product(1 - sqrt(w1 * w2 * d)) over all pairs of places of different words,
d = 1 / (1.005 + 0.05 * exp(distance / 1.5 - 2)), next to nothing beyond 100 words. These are the published formulas of
the rank that the results have to match. Queries without a word find nothing, null texts hold none.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.functions.stem import stem
from cutline.sources.places import new_path, register, stash

#: The English words that a full-text configuration leaves out.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Weights of the classes of fields, from headings to bodies.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
WORD = re.compile(r"[^\W_]+")
#: Stems that a Python worker keeps, and rows of one Arrow batch.
CACHED, AT_ONCE = 200_000, 20_000
#: Characters and documents of a shard; shards of the first round, by how much the rounds grow, and terms that may be broadcast.
SHARD_CHARS, SHARD_DOCS, FIRST_SHARDS, GROWTH, BROADCAST_TERMS = 24 << 20, 1 << 16, 12, 8, 1_000_000
#: Documents of a set that are ranked first, documents of the rarest terms and places that are met at once, and pairs of places.
FIRST, MET, AT_A_TIME, CROSSED = 64, 1 << 17, 1 << 15, 1 << 20
#: d by distance and its square roots, what a pair beyond 100 words adds (1 - 1e-16 as a double), and from where a rank is 1 as a double.
NEAR = 1 / (1.005 + 0.05 * np.exp(np.arange(101.0) / 1.5 - 2))
NEARNESS = np.sqrt(np.concatenate([[0.0], NEAR[1:]]))
FAR, FULL = 2.0**-53, 38.0
_POSTING = "shard long, term string, docs binary, sizes binary, places binary, fields binary"


class Postings(NamedTuple):
    rows: DataFrame
    key: str
    kind: str
    weights: tuple[float, ...]
    n_shards: int


def _stem(word: str, cache: dict[str, str]) -> str:
    found = cache.get(word)
    if found is None:
        if len(cache) >= CACHED:
            cache.clear()
        found = cache[word] = stem(word)
    return found


class _Numbers(dict):
    """Words to the numbers of their terms, -1 for stop words."""

    def __init__(self, cache: dict[str, str]):
        super().__init__()
        self.cache, self.terms = cache, {}

    def __missing__(self, word: str) -> int:
        found = self[word] = -1 if word in STOP_WORDS else self.terms.setdefault(_stem(word, self.cache), len(self.terms))
        return found


def _shard(shard: int, keys: list, kind: pa.DataType, texts: list[tuple], cache: dict[str, str]) -> pa.RecordBatch:
    """The rows of one shard, in the order of terms, behind one of the empty term with its keys in order."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    numbers, said, lengths, starts = _Numbers(cache), array("i"), [], []
    for i in order:
        base = 0
        for text in texts[i]:
            ids = list(map(numbers.__getitem__, WORD.findall((text or "").lower())))
            while ids and ids[-1] < 0:
                ids.pop()
            said.extend(ids)
            lengths.append(len(ids))
            starts.append(base)
            base += len(ids)
    lengths = np.array(lengths, np.int64)
    terms = np.frombuffer(said, np.int32) if len(said) else np.zeros(0, np.int32)
    field = np.repeat(np.arange(len(lengths)), lengths)
    n_fields = len(texts[0])
    places = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths - np.array(starts, np.int64), lengths) + 1
    by = sorted(numbers.terms)
    rank = np.full(len(by) + 1, -1, np.int32)
    rank[[numbers.terms[t] for t in by]] = np.arange(len(by))
    terms = rank[terms]
    sort = np.argsort(terms, kind="stable")[int((terms < 0).sum()) :]
    terms, field, places = terms[sort], field[sort], places[sort]
    docs = field // n_fields
    fresh = np.flatnonzero(np.append(True, (np.diff(terms) != 0) | (np.diff(docs) != 0))) if len(terms) else np.zeros(0, np.int64)
    edges = np.searchsorted(terms, np.arange(len(by) + 1))
    posts = np.searchsorted(fresh, edges)

    def spread(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        data = np.ascontiguousarray(values)
        offsets = np.append(0, cuts).astype(np.int32) * data.itemsize  # the first row is empty
        return pa.BinaryArray.from_buffers(pa.binary(), len(by) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    columns = [
        pa.array(np.full(len(by) + 1, shard)), pa.array(["", *by], pa.string()), spread(docs[fresh].astype(np.uint16), posts), spread(np.diff(np.append(fresh, len(terms))).astype(np.uint32), posts),
        spread(places.astype(np.uint32), edges), spread((field % n_fields).astype(np.uint8), edges), pa.array([[keys[i] for i in order]] + [None] * len(by), pa.list_(kind)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "docs", "sizes", "places", "fields", "keys"])


def build_postings(docs: DataFrame, key: str, fields: Sequence[tuple[str, str]]) -> Postings:
    """The postings of all documents, stored. fields: a text column and its class (A to D) each, in the order of their places.

    Each task cuts its documents into shards of bounded bytes and writes these: one pass, nothing is shuffled.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, size = TaskContext.get().partitionId(), 0, 0
        cache: dict[str, str] = {}
        keys: list = []
        texts: list[tuple] = []

        def out(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            rows = _shard(part << 32 | made, keys, kind, texts, cache)
            for i in range(0, len(rows), AT_ONCE):
                yield rows.slice(i, AT_ONCE)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            # one text after the other: a batch may hold more than a shard
            for row_key, *text in zip(*batch.columns, strict=True):
                text = tuple(x.as_py() for x in text)
                n = sum(len(x or "") for x in text)
                if keys and (size + n > SHARD_CHARS or len(keys) == SHARD_DOCS):
                    yield from out(kind)
                    made, size, keys, texts = made + 1, 0, [], []
                keys.append(row_key.as_py())
                texts.append(text)
                size += n
        if keys:
            yield from out(kind)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *(F.col(f).alias(f"f{i}") for i, (f, _) in enumerate(fields))).mapInArrow(cut, f"{_POSTING}, keys array<{kind}>")
    held = stash(rows, "postings")
    return Postings(held, key, kind, tuple(float(np.float32(WEIGHTS[c])) for _, c in fields), held.where("term = ''").count())


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """query and its distinct terms in order; queries without a word or an id are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in batches:
            found = [list({_stem(w, cache) for w in WORD.findall((x or "").lower()) if w not in STOP_WORDS}) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], [query, "terms"])

    kind = queries.schema[query].dataType.simpleString()
    cut_up = queries.where(F.col(query).isNotNull()).select(query, text).mapInArrow(cut, f"{query} {kind}, terms array<string>")
    return cut_up.where(F.size("terms") > 0).select(query, F.array_sort("terms").alias("terms")).distinct()


def rank_of(entries: Sequence[tuple[Sequence[int], Sequence[float]]]) -> float:
    """The rank of a text that holds all words of a query, in the order of the terms: places and weights of each."""
    if len(entries) == 1:
        weights = np.asarray(entries[0][1], np.float64)
        squares = np.arange(1, len(weights) + 1) ** 2
        top = int(weights.argmax())
        return float((weights[top] + (weights / squares).sum() - weights[top] / squares[top]) / (math.pi**2 / 6))
    rest = 1.0
    for i, (places, weights) in enumerate(entries):
        for other, other_weights in entries[:i]:
            step = max(1, CROSSED // len(other))
            for at in range(0, len(places), step):
                distance = np.abs(np.subtract.outer(np.asarray(places[at : at + step], np.float64), np.asarray(other, np.float64)))
                near = np.where(distance > 100, 1e-30, 1 / (1.005 + 0.05 * np.exp(np.minimum(distance, 100) / 1.5 - 2)))
                each = np.sqrt(np.multiply.outer(np.asarray(weights[at : at + step], np.float64), np.asarray(other_weights, np.float64)) * near)
                rest *= float(np.prod(1 - each[distance > 0]))
    return 1 - rest


def _nth(of: np.ndarray) -> np.ndarray:
    """The place of each row among those of its set; ``of`` ascends."""
    return np.arange(len(of)) - np.searchsorted(of, of)


def _kth(of: np.ndarray, values: np.ndarray, k: int, n: int, none: float) -> np.ndarray:
    """The k-th largest value of each of n sets, ``none`` of those with fewer."""
    order = np.lexsort((-values, of))
    at = np.searchsorted(of[order], np.arange(n + 1))
    some = np.flatnonzero(np.diff(at) >= k)
    out = np.full(n, none, values.dtype)
    out[some] = values[order[at[some] + k - 1]]
    return out


class _Shard:
    """The postings of the wanted terms in one shard of documents, by term, document and place. Documents are in the order of their keys.

    Many sets of as many terms each are met at once: ``of`` is the set of each document that is found, ``rows`` has a
    row for each term with its posting there.
    """

    def __init__(self, table: pa.Table, weights: Sequence[float]):
        rows = table.take(pc.sort_indices(table.column("term"))).combine_chunks()
        self.keys, rows = rows.column("keys")[0].as_py(), rows.slice(1)
        flat = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind)
        self.terms = rows.column("term").combine_chunks()
        self.docs, self.sizes = flat("docs", np.uint16).astype(np.int64), flat("sizes", np.uint32).astype(np.int64)
        self.place = flat("places", np.uint32).astype(np.int64)
        self.heavy = np.array(weights)[flat("fields", np.uint8)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = pc.binary_length(rows.column("docs").combine_chunks()).to_numpy().astype(np.int64) // 2
        self.n_docs, self.firsts = n, np.cumsum(n) - n
        self.n_places = pc.binary_length(rows.column("fields").combine_chunks()).to_numpy().astype(np.int64)
        self.posted = np.repeat(np.arange(len(n)), n) << 16 | self.docs

    def meet(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """terms: a row for each set. The documents that hold all terms of a set, ascending."""
        n = self.n_docs[terms]
        order = np.argsort(n, axis=1, kind="stable")
        rarest, n = terms[np.arange(len(terms)), order[:, 0]], n[np.arange(len(terms)), order[:, 0]]
        of = np.repeat(np.arange(len(terms)), n)
        held = [np.arange(len(of)) + np.repeat(self.firsts[rarest] - (np.cumsum(n) - n), n)]
        docs = self.docs[held[0]]
        for i in range(1, terms.shape[1]):
            wanted = terms[of, order[of, i]] << 16 | docs
            to = np.minimum(np.searchsorted(self.posted, wanted), len(self.posted) - 1)
            fits = self.posted[to] == wanted
            of, docs, held = of[fits], docs[fits], [h[fits] for h in held] + [to[fits]]
        rows = np.empty((terms.shape[1], len(of)), np.int64)
        rows[order.T[:, of], np.arange(len(of))] = np.stack(held)
        return of, rows

    def spread(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the postings, and where among the places, for all places of the postings."""
        sizes = self.sizes[rows]
        which = np.repeat(np.arange(len(rows)), sizes)
        return which, np.arange(len(which)) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)

    def alone(self, rows: np.ndarray) -> np.ndarray:
        """The ranks of one word, but for rounding."""
        which, at = self.spread(rows)
        n = at - self.starts[rows][which] + 1
        edges = np.cumsum(self.sizes[rows]) - self.sizes[rows]
        top = np.maximum.reduceat(self.heavy[at], edges)
        first = np.minimum.reduceat(np.where(self.heavy[at] == top[which], n, len(n) + 1), edges).astype(np.float64)
        return (top + np.add.reduceat(self.heavy[at] / n.astype(np.float64) ** 2, edges) - top / first**2) / (math.pi**2 / 6)

    def logs(self, rows: np.ndarray) -> np.ndarray:
        """Minus the logarithms of what the ranks of several words leave to 1, but for rounding: only places within 100 words are met."""
        out = np.zeros(rows.shape[1])
        for i in range(len(rows)):
            for j in range(i):
                a, b = (rows[i], rows[j]) if self.sizes[rows[i]].sum() <= self.sizes[rows[j]].sum() else (rows[j], rows[i])
                own, other = self.spread(a), self.spread(b)
                here, there = (which << 32 | self.place[at] for which, at in (own, other))
                lo = np.searchsorted(there, here - 100)
                n = np.searchsorted(there, here + 100, side="right") - lo
                mine = np.repeat(np.arange(len(n)), n)
                theirs = np.arange(len(mine)) + np.repeat(lo - (np.cumsum(n) - n), n)
                p, q = own[1][mine], other[1][theirs]
                each = np.sqrt(self.heavy[p] * self.heavy[q]) * NEARNESS[np.abs(self.place[p] - self.place[q])]
                met = np.bincount(own[0], n, len(out))
                out += np.bincount(own[0][mine], -np.log1p(-each), len(out)) + FAR * (self.sizes[a] * self.sizes[b] - met)
        return out

    def most(self, rows: np.ndarray) -> np.ndarray:
        """What ``logs`` can't exceed: a place has two others at most at each distance."""
        out = np.zeros(rows.shape[1])
        sizes, top = self.sizes[rows], self.heavy.max(initial=0.0)
        each = -np.log1p(-top * NEARNESS)
        for i in range(len(rows)):
            for j in range(i):
                pairs = sizes[i] * sizes[j]
                out += np.minimum(pairs * each[1], np.minimum(sizes[i], sizes[j]) * 2 * each.sum()) + FAR * pairs
        return out * (1 + 1e-9)

    def crossed(self, rows: np.ndarray) -> np.ndarray:
        """Pairs of places of different words in each document."""
        sizes = self.sizes[rows]
        return (sizes.sum(0) ** 2 - (sizes**2).sum(0)) // 2

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """``rank_of`` each document, to the last digit: the same products in the same order, of many documents at once."""
        out = np.zeros(rows.shape[1])
        crossed = self.crossed(rows)
        one = lambda r: (self.place[self.starts[r] : self.starts[r] + self.sizes[r]], self.heavy[self.starts[r] : self.starts[r] + self.sizes[r]])
        if len(rows) == 1:
            known: dict[bytes, float] = {}
            for i, r in enumerate(rows[0]):
                entry = one(r)
                same = entry[1].tobytes()
                if same not in known:
                    known[same] = rank_of([entry])
                out[i] = known[same]
            return out
        for i in np.flatnonzero(crossed > CROSSED):
            out[i] = rank_of([one(r) for r in rows[:, i]])
        for some in _pieces(np.flatnonzero(crossed <= CROSSED), crossed, CROSSED):
            rest = np.ones(len(some))
            for i in range(len(rows)):
                for j in range(i):
                    a, b = rows[i, some], rows[j, some]
                    n = self.sizes[a] * self.sizes[b]
                    edges = np.cumsum(n) - n
                    at = np.arange(n.sum()) - np.repeat(edges, n)
                    nth, of_nth = np.divmod(at, np.repeat(self.sizes[b], n))
                    p, q = np.repeat(self.starts[a], n) + nth, np.repeat(self.starts[b], n) + of_nth
                    distance = np.abs(self.place[p] - self.place[q])
                    near = np.where(distance > 100, 1e-30, NEAR[np.minimum(distance, 100)])
                    left = 1 - np.sqrt(self.heavy[p] * self.heavy[q] * near)
                    rest *= np.multiply.reduceat(np.where(distance > 0, left, 1.0), edges)
            out[some] = 1 - rest
        return out

    def best(self, terms: np.ndarray, k: int, floor: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best documents of each set: set, place among the keys, score. Only those over its ``floor``, or at it and before ``before``."""
        of, rows = self.meet(terms)
        docs, n = self.docs[rows[0]], len(terms)
        if terms.shape[1] == 1:
            about = self.alone(rows[0]) if len(docs) else np.zeros(0)
            slack, full = np.full(len(docs), 1e-14), np.zeros(len(docs), bool)
        else:
            bound = -np.expm1(-self.most(rows)) + 1e-15
            take = np.flatnonzero((bound > floor[of]) | (bound >= floor[of]) & (docs < before[of]))
            take = take[np.lexsort((docs[take], -np.minimum(bound[take], 1.0), of[take]))]
            of, rows, docs, bound = of[take], rows[:, take], docs[take], bound[take]
            nth, crossed, sizes = _nth(of), self.crossed(rows), self.sizes[rows].sum(0)
            about, slack, full, done = np.zeros(len(docs)), np.zeros(len(docs)), np.zeros(len(docs), bool), np.zeros(len(docs), bool)
            at, limit, kth, last = 0, max(FIRST, 2 * k), floor, np.full(n, len(self.keys))
            while at <= nth.max(initial=-1):
                # the highest bounds of each set first; what can't be among the k best is left out unread
                todo = np.flatnonzero((nth >= at) & (nth < at + limit) & (bound >= kth[of]) & (docs < last[of]))
                for piece in _pieces(todo, sizes, AT_A_TIME):
                    left = self.logs(rows[:, piece])
                    about[piece], full[piece] = -np.expm1(-left), left > FULL
                    # rounding, of these sums and of the products, is in proportion to what is left to 1
                    slack[piece] = 1e-15 * (16 + np.exp(-left) * (crossed[piece] * (1 + left) + 80 * left))
                done[todo] = True
                kth = np.maximum(kth, _kth(of[done], (about - slack)[done], k, n, -1.0))
                certain = done & full
                last = np.minimum(last, 1 - _kth(of[certain], -docs[certain], k, n, -len(self.keys)))
                at, limit = at + limit, limit * 4
            of, rows, docs, about, slack, full = of[done], rows[:, done], docs[done], about[done], slack[done], full[done]
            slack[full], about[full] = 0, 1.0
        keep = about + slack >= np.maximum(floor, _kth(of, about - slack, k, n, -1.0))[of]
        certain = keep & full  # of those at 1 the first k by key
        keep &= ~full | (docs <= -_kth(of[certain], -docs[certain], k, n, -len(self.keys))[of])
        of, rows, docs, full = of[keep], rows[:, keep], docs[keep], full[keep]
        scores = np.ones(len(of))
        scores[~full] = self.exact(rows[:, ~full])
        good = np.flatnonzero((scores > floor[of]) | (scores == floor[of]) & (docs < before[of]))
        good = good[np.lexsort((docs[good], -scores[good], of[good]))]
        good = good[_nth(of[good]) < k]
        return of[good], docs[good], scores[good]


def _pieces(rows: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """In their order, as many together as have ``most`` in all."""
    cuts = np.cumsum(sizes[rows]) // most
    return [p for p in np.split(rows, np.flatnonzero(np.diff(cuts)) + 1) if len(p)]


def _search_shard(table: pa.Table, weights: Sequence[float], key: str, kind: pa.DataType, k: int, sheet: pa.Table) -> pa.Table:
    """All sets of terms (set, terms, floor, floor_key) against one shard: set, key, score."""
    sets, docs, scores = [np.zeros(0, np.int64)], [], [np.zeros(0)]
    if len(table) > 1 and len(sheet):
        shard = _Shard(table, weights)
        terms = sheet.column("terms").combine_chunks()
        at = pc.fill_null(pc.index_in(terms.flatten(), value_set=shard.terms), -1).to_numpy().astype(np.int64)
        lengths = pc.list_value_length(terms).to_numpy()
        edges = np.cumsum(lengths) - lengths
        ids, floor_keys = sheet.column("set").to_numpy(), sheet.column("floor_key").to_pylist()
        floor = pc.fill_null(sheet.column("floor"), -1.0).to_numpy()
        before = np.array([len(shard.keys) if x is None else bisect_left(shard.keys, x) for x in floor_keys], np.int64)
        held = np.minimum.reduceat(at, edges) >= 0
        for m in np.unique(lengths[held]).tolist():
            some = np.flatnonzero(held & (lengths == m))
            own = at[edges[some][:, None] + np.arange(m)]
            read = shard.n_places[own[:, 0]] if m == 1 else shard.n_docs[own].min(1)
            for piece in _pieces(np.arange(len(some)), read, MET):
                of, found, score = shard.best(own[piece], k, floor[some[piece]], before[some[piece]])
                sets.append(ids[some[piece]][of])
                docs += [shard.keys[i] for i in found.tolist()]
                scores.append(score)
    return pa.table({"set": np.concatenate(sets), key: pa.array(docs, kind), "score": np.concatenate(scores)})


def _searcher(path: str, weights: Sequence[float], key: str, k: int) -> Callable[[pa.Table], pa.Table]:
    def look(table: pa.Table) -> pa.Table:
        fs, place = pa.fs.FileSystem.from_uri(path)
        return _search_shard(table, weights, key, table.schema.field("keys").type.value_type, k, pq.read_table(place, filesystem=fs))

    return look


def search(postings: Postings, queries: DataFrame, query: str, text: str, k: int) -> DataFrame:
    """The k best documents of each query: query, key, score, rank (ties: the lower key).

    Queries of the same terms are one set of terms. Each shard meets all sets in memory, with the postings of their
    terms, and gives the k best of each, so no pair of a query and a document that isn't among them is ever written.
    Shards come in rounds that grow: later ones give only what beats the k-th best of the rounds before.
    """
    key, spark = postings.key, postings.rows.sparkSession
    asked = stash(query_terms(queries, query, text), "asked")
    sets = stash(asked.select("terms").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
    wanted = stash(sets.select(F.explode("terms").alias("term")).unionByName(spark.sql("SELECT '' AS term")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
    bucket = F.pmod(F.xxhash64("shard"), F.lit(max(1, postings.n_shards)))
    best, begin, end = None, 0, FIRST_SHARDS
    while best is None or begin < postings.n_shards:
        floors = sets.withColumns({"floor": F.lit(None).cast("double"), "floor_key": F.lit(None).cast(postings.kind)})
        if best is not None:
            floors = sets.join(best.where(F.col("rank") == k).select("set", F.col("score").alias("floor"), F.col(key).alias("floor_key")), "set", "left")
        path = register(spark, new_path(spark, "floors"))
        floors.write.parquet(path)
        held = postings.rows.where((bucket >= begin) & (bucket < end)).join(wanted, "term", "left_semi")
        found = held.groupBy("shard").applyInArrow(_searcher(path, postings.weights, key, k), f"set long, {key} {postings.kind}, score double")
        found = found if best is None else found.unionByName(best.drop("rank"))
        order = Window.partitionBy("set").orderBy(F.desc("score"), key)
        best = stash(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        begin, end = end, end * GROWTH
    return asked.join(sets, "terms").select(query, "set").join(best, "set").select(query, key, "score", "rank")
