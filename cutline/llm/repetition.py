"""Repetition coverage: characters of a text inside duplicated n-grams and lines, found with rolling hashes.

Words are runs without ASCII white space. For each length in ``lengths`` a window of that many words is duplicated
if it occurs twice or more in the text; a word is covered if it lies in any such window, first occurrences included.

Null and empty texts have no words: all measures are 0 and ``base_failed`` is true. Rows are measured one by one, so
repeated rows give repeated results and ties don't arise; an empty table gives an empty result. Other columns are
ignored. A text of any length is one piece of work of memory in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import Flat, covered, earlier, gram_hashes, mix, repeated, runs, span_hashes
from .shared import text_slices

#: Most per cent of the characters in words that duplicated windows of so many words may cover.
LIMITS = {5: 20, 8: 17, 12: 15}
#: Most per cent of the characters in words that may stand in lines equal to an earlier line.
LINE_LIMIT = 30
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def measure(texts: list[str], lengths: tuple[int, ...] = tuple(LIMITS)) -> dict[str, np.ndarray]:
    """The measures of each text, as arrays in the order of ``texts``."""
    f = Flat(texts)
    start, end, doc = f.words()
    chars = f.points[end] - f.points[start]
    h = span_hashes(f.roll, start, end)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=f.n).astype(np.int64)

    out = {"n_words": np.bincount(doc, minlength=f.n), "word_chars": per_text(chars), "n_symbols": f.count(_SYMBOL[f.data])}

    ls, le = runs(f.data != 10)
    first_word = np.searchsorted(start, ls)
    worded = np.searchsorted(start, le) > first_word
    ls, le = ls[worded], le[worded]
    line_doc = f.doc_of(ls)
    again = earlier(span_hashes(f.roll, ls, le) ^ mix(line_doc.astype(np.uint64) + np.uint64(1)))
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=f.n)
    line_of = np.searchsorted(ls, start, "right") - 1
    out["dup_line_chars"] = per_text(chars * again[line_of]) if len(ls) else np.zeros(f.n, np.int64)

    for n in sorted({5, *lengths}):
        at, grams = gram_hashes(h, doc, n)
        inside = covered(len(h), at[repeated(grams)], n)
        if n == 5:
            out["n_repeat_words"] = per_text(inside)
        if n in lengths:
            out[f"dup{n}_chars"] = per_text(chars * inside)
    return out


def repetition(docs: DataFrame, limits: dict[int, int] = LIMITS, line_limit: int = LINE_LIMIT) -> DataFrame:
    """Measure each document and decide whether to keep it: doc_id, the measures, base_failed, kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup{n}_chars" for n in sorted(limits))]
    lengths = tuple(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            got = measure(texts, lengths)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[k], pa.int64()) for k in names)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in names))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    heavy = 100 * F.col("dup_line_chars") > line_limit * F.col("word_chars")
    for n, most in limits.items():
        heavy = heavy | (100 * F.col(f"dup{n}_chars") > most * F.col("word_chars"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~heavy)
