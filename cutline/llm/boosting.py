"""Histogram gradient-boosted trees over document statistics, flattened into arrays for numpy traversal.

Training takes at most ``max_rows`` labelled rows (a documented bound); scoring covers every row and whole texts.
Null and empty texts get the statistics of an empty text and so a score. Labels that are null are left out, repeated
labels of a document count once as their mean, at least a half being 1. With no labels at all every score is 0.5.
Ties between splits go to the first statistic and lowest bin. Other columns of the tables are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import Flat, covered, earlier, gram_hashes, mix, repeated, runs, span_hashes
from .shared import text_slices

STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "letters", "digits", "symbols", "bangs", "stops",
    "non_ascii", "unique_words", "same_as_previous", "repeated_pairs", "repeated_fives", "lines", "line_length",
    "repeated_lines", "words_upper", "words_ending_in_symbol", "words_with_digit",
)


def _mark(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _mark(bytes(range(65, 91))), _mark(b"0123456789")
_LETTER = _mark(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_SYMBOL, _BANG, _STOP = _mark(b"#*$%&|<>@^~_=+{}[]\\/"), _mark(b"!?"), _mark(b".,;:")


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS for each text."""
    f = Flat(texts)
    start, end, doc = f.words()
    size = np.maximum(f.end - f.start, 1)
    words = np.bincount(doc, minlength=f.n)
    some = np.maximum(words, 1)
    h = span_hashes(f.roll, start, end)

    def share(mask: np.ndarray) -> np.ndarray:
        return f.count(mask[f.data]) / size

    def of_words(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=f.n) / some

    def inside(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(f.data) + 1, np.int64)
        np.cumsum(mask[f.data], out=sums[1:])
        return sums[end] - sums[start]

    salted = h ^ mix(doc.astype(np.uint64) + np.uint64(1))
    previous = np.zeros(len(h), bool)
    previous[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = {}
    for n in (2, 5):
        at, grams = gram_hashes(h, doc, n)
        again[n] = covered(len(h), at[repeated(grams)], n)
    longest = np.zeros(f.n, np.int64)
    np.maximum.at(longest, doc, end - start)
    ls, le = runs(f.data != 10)
    line_doc = f.doc_of(ls)
    lines = np.bincount(line_doc, minlength=f.n)
    same = earlier(span_hashes(f.roll, ls, le) ^ mix(line_doc.astype(np.uint64) + np.uint64(1)))
    length = end - start
    columns = [
        np.log1p(f.end - f.start), np.log1p(words), of_words(length), longest, share(_UPPER), share(_LETTER), share(_DIGIT),
        share(_SYMBOL), share(_BANG), share(_STOP), share(_mark(bytes(range(128, 256)))), 1 - of_words(earlier(salted)),
        of_words(previous), of_words(again[2]), of_words(again[5]), np.log1p(lines), words / np.maximum(lines, 1),
        np.bincount(line_doc[same], minlength=f.n) / np.maximum(lines, 1), of_words(2 * inside(_UPPER) > length),
        of_words((_SYMBOL | _BANG)[f.data[end - 1]]) if len(end) else np.zeros(f.n), of_words(inside(_DIGIT) > 0),
    ]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Forest:
    """Complete trees of one depth: node k of a tree has children 2k + 1 and 2k + 2; leaves have their own array."""

    depth: int
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # the right child takes values above it
    leaf: np.ndarray  # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 2.0, ridge: float = 1.0) -> Forest:
    """Boost logistic loss; each split is the best over histograms of gradients by bin of each statistic."""
    inner = 2**depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32)
    leaf = np.zeros((trees, 2**depth))
    if not len(y):
        return Forest(depth, 0.0, feature[:0], threshold[:0], leaf[:0])
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1)
    cell = binned + np.arange(width) * bins
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, w = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (width * bins) + cell).ravel()
            gs = np.bincount(slot, np.repeat(g, width), count * width * bins).reshape(count, width, bins).cumsum(2)
            ws = np.bincount(slot, np.repeat(w, width), count * width * bins).reshape(count, width, bins).cumsum(2)
            g_all, w_all = gs[:, :1, -1:], ws[:, :1, -1:]
            gain = gs**2 / (ws + ridge) + (g_all - gs) ** 2 / (w_all - ws + ridge) - g_all**2 / (w_all + ridge)
            gain[(ws < least) | (w_all - ws < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, w, 2**depth) + ridge)
        total += leaf[t, at]
    return Forest(depth, base, feature, threshold, leaf)


def _statistics_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            rows = statistics(texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<float>")


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", max_rows: int = 20_000) -> Forest:
    """Fit on at most about ``max_rows`` labelled documents for which ``learn`` (of doc_id) holds, chosen by a hash."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    share = min(1.0, max_rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * max_rows)
    # a doc_id that comes with several texts counts once, with the least of them: no more rows than labels are gathered
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = _statistics_of(chosen).join(F.broadcast(known), "doc_id").select("x", "y").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(-1, len(STATISTICS))
    y = rows.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score, the probability of label 1, of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(statistics(texts)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
