"""Byte-pair encoding with word ends: a lexicon of the corpus's frequent words, and exact merges for the others.

The frequent words of all documents are merged once and compiled into a minimal acyclic transducer with their ids as
outputs; workers memory-map it and look up the distinct words of many texts side by side. Words that it lacks are
merged with the vocabulary's own rules. The ids equal those of the tokenizers library for a vocabulary of this kind:
NFC, lower case, white space dropped, contractions, letters, single digits and other characters apart, ``</w>``.

A null text is empty: no ids, and its decoded text is empty. Rows are encoded one by one: repeated rows give repeated
results, an empty table an empty one (and no lexicon). Other columns are ignored. Long texts are encoded whole, and so
are long words, in n log n steps for n bytes; words of over ``LONGEST`` characters are never in the lexicon.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_words, to_bytes
from .flat import gather, grouped, rolling, span_hashes
from .shared import drop, new_path, register, stash, text_slices, write_bytes

#: Words that the lexicon holds at most, the characters of the longest, and other words that a task keeps.
LEXICON_WORDS = 1 << 17
LONGEST = 64
CACHE_WORDS = 1 << 17
#: Ranges of counts that one pass over the words tells apart.
BINS = 1024
_OTHER, _LETTER, _NUMBER, _SPACE, _SPECIAL = range(5)
#: Stand for the special tokens inside a text; no valid text holds surrogates.
_STAND_INS = 0xD800


@cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else those from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@cache
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LN":
            out[code] = _LETTER if kind[0] == "L" else _NUMBER
        elif kind in ("Zs", "Zl", "Zp"):
            out[code] = _SPACE
    out[[*range(0x09, 0x0E), 0x85]] = _SPACE
    out[0xD800:0xE000] = _SPECIAL
    return out


class Vocabulary:
    """What a tokenizer file of this kind holds, and exact merging by it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        ids: dict[str, int] = held["model"]["vocab"]
        end = held["model"]["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in held["added_tokens"]}
        names = ids | self.specials
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        self.inner = [ids[c] for c in byte_letters()]
        self.last = [ids[c + end] for c in byte_letters()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])
        self.merges = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is joined, the leftmost first, until no pair has a rule."""
        parts = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        rules, n = self.merges, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int]] = []  # rank, place, the pair, what it becomes

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (rule := rules.get(pair := parts[i] << 32 | parts[j])):
                heapq.heappush(queue, (rule[0], i, pair, rule[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, pair, joined = heapq.heappop(queue)
            j = after[i]
            if j >= n or parts[i] << 32 | parts[j] != pair:
                continue  # one of the two has become part of another pair
            parts[i], parts[j] = joined, -1
            after[i] = k = after[j]
            after[j] = n
            if k < n:
                before[k] = i
            offer(before[i], i)
            offer(i, k)
        return [x for x in parts if x >= 0]


class Words:
    """The words of some texts: distinct ones as bytes, and the group of each word in order."""

    def __init__(self, texts: list[str], specials: dict[str, int]):
        clean = []
        for text in texts:
            for i, name in enumerate(specials):
                text = text.replace(name, chr(_STAND_INS + i))
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            clean.append(text.lower())
        chars = np.frombuffer(("\n".join(clean) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, clean), np.int64, len(clean))
        kind = _classes()[chars]
        space = kind == _SPACE
        begin = ~space
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER) | (kind[1:] == _SPECIAL)
        self._contractions(chars, begin)
        stop = ~space
        stop[:-1] &= begin[1:] | space[1:]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        some, self.group = grouped(span_hashes(rolling(chars), start, end))
        self.start, self.end = start[some], end[some]
        texts_end = np.cumsum(lengths + 1)
        bounds = np.searchsorted(start, texts_end)
        #: Words of text i: group[bounds[i] : bounds[i + 1]].
        self.bounds = np.concatenate(([0], bounds))
        self.special = np.where(kind[self.start] == _SPECIAL, chars[self.start].astype(np.int64) - _STAND_INS, -1)
        joined = gather(chars, self.start, self.end - self.start).tobytes().decode("utf-32-le", "surrogatepass")
        cuts = np.cumsum(self.end - self.start).tolist()
        self.distinct = [joined[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if cuts else []

    @staticmethod
    def _contractions(chars: np.ndarray, begin: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are words where an apostrophe begins one; what follows begins another."""
        at = np.flatnonzero((chars == 0x27) & begin)
        if not len(at):
            return
        padded = np.concatenate((chars, np.zeros(2, np.uint32)))
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        long &= ~short
        begin[at[short | long] + 1] = False
        for chosen, size in ((short, 2), (long, 3)):
            after = at[chosen] + size
            after = after[after < len(chars)]
            begin[after] |= _classes()[chars[after]] != _SPACE


class Encoder:
    """Encodes texts with a memory-mapped lexicon (None: without) and the vocabulary's merges."""

    def __init__(self, vocabulary: Vocabulary, lexicon: str | None):
        self.vocabulary = vocabulary
        self.lexicon = Automaton(lexicon) if lexicon else None
        self.merged: dict[bytes, list[int]] = {}

    def encode(self, texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words; ids of all distinct words end to end; first id and number of ids of each distinct word."""
        words = Words(texts, self.vocabulary.specials)
        raw = [w.encode("utf-8", "surrogatepass") for w in words.distinct]
        n = len(raw)
        place = np.full(n, -1, np.int64)
        sizes = np.fromiter(map(len, raw), np.int64, n)
        if self.lexicon is not None and n:
            end = np.cumsum(sizes)
            place = self.lexicon.places(np.frombuffer(b"".join(raw), np.uint8), end - sizes, end)
        place[words.special >= 0] = -1
        held = np.zeros(0, np.uint32) if self.lexicon is None else self.lexicon.ids
        first, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        known = place >= 0
        if known.any():
            first[known] = self.lexicon.first[place[known]]
            counts[known] = self.lexicon.first[place[known] + 1] - first[known]
        extra: list[int] = []
        if len(self.merged) > CACHE_WORDS:
            self.merged.clear()
        special_ids = list(self.vocabulary.specials.values())
        for i in np.flatnonzero(~known).tolist():
            if words.special[i] >= 0:
                ids = [special_ids[words.special[i]]]
            elif (ids := self.merged.get(raw[i])) is None:
                ids = self.vocabulary.merge(raw[i])
                if sizes[i] <= 4 * LONGEST:
                    self.merged[raw[i]] = ids
            first[i], counts[i] = len(held) + len(extra), len(ids)
            extra += ids
        return words, np.concatenate((held, np.array(extra, np.uint32))) if extra else held, first, counts


def word_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Stored: word and n, how often each word of up to LONGEST characters occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = Vocabulary(vocabulary_path).specials
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for _, texts in text_slices(batches, "text"):
            words = Words(texts, specials)
            for word, n, special in zip(words.distinct, np.bincount(words.group, minlength=len(words.distinct)).tolist(), words.special.tolist(), strict=True):
                if special < 0 and len(word) <= LONGEST:
                    counts[word] += n
            if len(counts) > CACHE_WORDS:
                yield rows()
                counts.clear()
        yield rows()

    return stash(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def least_count(counted: DataFrame, most: int) -> int:
    """The least count for which at most ``most`` words occur as often or oftener, found by histograms of BINS ranges."""
    low, high = 1, (counted.agg(F.max("n")).first()[0] or 0) + 1  # the answer lies in low to high
    over = 0  # words that occur ``high`` times or more
    while low < high:
        width = -(-(high - low) // BINS)
        inside = counted.where((F.col("n") >= low) & (F.col("n") < high)).groupBy(F.floor((F.col("n") - low) / width).alias("bin")).count().collect()
        for nth, words in sorted(inside, reverse=True):
            if over + words > most:
                low, high = low + nth * width, min(high, low + (nth + 1) * width)
                break
            over += words
        else:
            return low
        if width == 1:
            return high
    return high


def build_lexicon(docs: DataFrame, vocabulary_path: str, most: int = LEXICON_WORDS) -> str | None:
    """Compile the most frequent words, at most ``most``, into a file that every executor gets; returns its name for SparkFiles.

    Words whose count is that of too many others stay out together. One task gets the chosen words and writes the file.
    """
    spark = docs.sparkSession
    counted = word_counts(docs, vocabulary_path)
    chosen = counted.where(F.col("n") >= least_count(counted, most)).select("word")
    folder = register(spark, new_path(spark, "lexicon"))

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sorted(w.encode() for batch in batches for w in batch.column(0).to_pylist())
        if words:
            vocabulary, uri = Vocabulary(vocabulary_path), f"{folder}/{uuid.uuid4().hex}.bin"
            write_bytes(uri, to_bytes(compile_words(words, [vocabulary.merge(w) for w in words])))
            yield pa.RecordBatch.from_arrays([pa.array([uri])], ["uri"])

    made = chosen.repartition(1).mapInArrow(compiled, "uri string").first()
    drop(counted)
    if made is None:
        return None
    spark.sparkContext.addFile(made["uri"])
    return made["uri"].rpartition("/")[2]


def encode(docs: DataFrame, vocabulary_path: str, lexicon: str | None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of each row."""
    return _encoded(docs, vocabulary_path, lexicon, False)


def encode_digests(docs: DataFrame, vocabulary_path: str, lexicon: str | None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids as little-endian unsigned 32-bit integers and of the decoded text."""
    return _encoded(docs, vocabulary_path, lexicon, True)


def _encoded(docs: DataFrame, vocabulary_path: str, lexicon: str | None, digests: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(vocabulary_path)
        encoder = Encoder(vocabulary, lexicon and SparkFiles.get(lexicon))
        names = np.array(vocabulary.names, object)
        for part, texts in text_slices(batches, "text"):
            words, ids, first, counts = encoder.encode(texts)
            flat = gather(ids, first[words.group], counts[words.group]).astype("<u4")
            ends = np.cumsum(counts[words.group])
            cuts = np.concatenate(([0], ends))[words.bounds]
            spelled = names[gather(ids, first, counts)].tolist()
            at = np.cumsum(counts).tolist()
            shown = [" ".join(spelled[a:b]) for a, b in zip([0, *at[:-1]], at, strict=True)] if at else []
            group, bounds = words.group.tolist(), words.bounds.tolist()
            decoded = (" ".join(map(shown.__getitem__, group[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
            if digests:
                raw = memoryview(flat).cast("B")
                own = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                columns = [pa.array(np.diff(cuts)), pa.array(own, pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(list(decoded), pa.string())], ["doc_id", "ids", "decoded"])

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")
