"""Token ids in binary shards with keyed access: a minimal perfect hash of document keys, fingerprints, raw payloads.

``write`` orders documents by doc_id (nulls first, then by text), encodes whole texts with the tokenizers library,
ends each with ``end_id`` and writes shards of about ``shard_ids`` ids to the shared folder. A shard is one file: a
JSON header of array lengths, the raw ids (16 or 32 bits, little-endian), the rows' starts and keys, and the index:
for each slot of the perfect hash a fingerprint and the first row of that key. A file's name is new for each attempt
of a task and only those of finished tasks are in the manifest, so lost executors leave no wrong shard.

Null texts are empty and have the end id only. Rows that repeat a doc_id stand next to each other; a key's entry leads
to the first and the reader takes all. Rows without doc_id are stored first and have no key. An empty table has no
shards. Other columns are ignored. Long texts are encoded whole; one row makes a shard of its own if it must.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .flat import Flat, gather, grouped, span_hashes
from .perfect_hash import PerfectHash, fingerprint
from .shared import new_path, read_bytes, register, stash, text_slices, write_bytes

#: Ids of a shard, about; encoded pieces of text that a task keeps; pieces and characters encoded at once.
SHARD_IDS = 2 << 20
CACHE_PIECES = 1_000_000
AT_ONCE, CHARS_AT_ONCE = 10_000, 1 << 19
_LETTER, _MARK, _ACCENTED = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
#: Second bytes of U+00C0 to U+00FF, all letters but for the signs of multiplication and division.
_ACCENTED[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_MAGIC = b"IDSHARD1"
_ARRAYS = (("starts", np.int64), ("keys", np.int64), ("words", np.uint64), ("before", np.uint32), ("sizes", np.int64), ("rest", np.int64), ("prints", np.uint32), ("rows", np.uint32))
_MANIFEST = "part int, nth int, uri string, n_docs long, n_ids long, low long, high long"


class PieceEncoder:
    """Encodes texts with a byte-level tokenizer of the library; pieces of text that come again are encoded once.

    Texts are cut before a single space, around a single line feed and between a letter and a punctuation mark, in each
    case between characters that aren't white space: there such a tokenizer's own pattern always begins a new piece, so
    the ids are those of the whole text. Texts that hold a special token are not cut.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        f = Flat(texts)
        data = f.data
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & _ACCENTED[data[1:]]
        mark = _MARK[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:] = (letter | mark)[:-1]
        after[:-1] = (_LETTER[data] | mark | (data == 0xC3))[1:]
        alone = before & after
        cut = alone & ((data == 0x20) | (data == 0x0A))
        cut[1:] |= (alone & (data == 0x0A))[:-1] | (letter[:-1] & mark[1:])
        for i, text in enumerate(texts):
            if any(s in text for s in self.specials):
                cut[f.start[i] : f.end[i]] = False
        cut[f.start] = True
        cut[f.end[f.end < len(data)]] = True  # the line feed after each text is no part of it
        edge = np.append(np.flatnonzero(cut), len(data))
        start, end = edge[:-1], edge[1:]
        doc = f.doc_of(start)
        own = start < f.end[doc]
        start, end, doc = start[own], end[own], doc[own]
        h = span_hashes(f.roll, start, end)
        some, group = grouped(h)  # in order of the hashes
        start, end = start[some], end[some]
        first, counts = self._ids_of(h[some], data.tobytes(), start, end)
        ids = gather(self.pool, first[group], counts[group])
        return ids, np.bincount(doc, weights=counts[group], minlength=len(texts)).astype(np.int64)

    def _ids_of(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct pieces begin in the pool, and their numbers; new pieces are encoded by the library."""
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        held = np.zeros(len(keys), bool)
        held[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        new = np.flatnonzero(~held)
        lists: list[list[int]] = []
        for some in np.array_split(new, -(-len(new) // AT_ONCE)) if len(new) else []:
            pieces = [raw[a:b].decode() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
            lists += [one.ids for one in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        firsts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))))
        self.first = np.insert(self.first, at[new], firsts)
        self.counts = np.insert(self.counts, at[new], sizes)
        self.keys = np.insert(self.keys, at[new], keys[new])
        at = np.searchsorted(self.keys, keys)
        return self.first[at], self.counts[at]

    def _forget(self) -> None:
        self.keys, self.first, self.counts, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)


@cache
def _encoder(path: str) -> PieceEncoder:
    """One for each Python worker, which serves many tasks."""
    return PieceEncoder(path)


def shard_bytes(ids: np.ndarray, counts: np.ndarray, keys: np.ndarray, without_key: int) -> list[bytes]:
    """The file of one shard; rows are in order of their keys after the first ``without_key``, which have none."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    keyed = keys[without_key:]
    first = np.flatnonzero(np.append(True, keyed[1:] != keyed[:-1])) if len(keyed) else np.zeros(0, np.int64)
    table = PerfectHash.build(keyed[first])
    slot = table.slots(keyed[first])
    prints, rows = np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint32)
    prints[slot], rows[slot] = fingerprint(keyed[first]), first + without_key
    arrays = {"starts": np.concatenate(([0], np.cumsum(counts))), "keys": keys, "prints": prints, "rows": rows} | vars(table)
    head = json.dumps({"width": width, "ids": len(ids), "without_key": without_key} | {name: len(arrays[name]) for name, _ in _ARRAYS}).encode()
    parts = [_MAGIC, len(head).to_bytes(8, "little"), head + b" " * (-len(head) % 8)]
    for raw in (ids.astype(f"<u{width}").tobytes(), *(arrays[name].astype(kind).tobytes() for name, kind in _ARRAYS)):
        parts.append(raw + bytes(-len(raw) % 8))
    return parts


class Shard:
    """A shard as it is read from its bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != _MAGIC:
            raise ValueError("not a shard of ids")
        n = int.from_bytes(raw[8:16], "little")
        head = json.loads(raw[16 : 16 + n])
        at = 16 + n + -n % 8

        def take(kind: str | type, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes + -out.nbytes % 8
            return out

        self.ids = take(f"<u{head['width']}", head["ids"])
        held = {name: take(kind, head[name]) for name, kind in _ARRAYS}
        self.without_key, self.starts, self.keys, self.prints, self.rows = head["without_key"], held["starts"], held["keys"], held["prints"], held["rows"]
        self.table = PerfectHash(held["words"], held["before"], held["sizes"], held["rest"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key, or -1: the slot's fingerprint is compared, then the stored key."""
        row = np.full(len(keys), -1, np.int64)
        if len(self.prints):
            slot = self.table.slots(keys)
            ok = slot >= 0
            ok[ok] &= self.prints[slot[ok]] == fingerprint(keys[ok])
            row[ok] = self.rows[slot[ok]]
            row[ok] = np.where(self.keys[row[ok]] == keys[ok], row[ok], -1)
        return row

    def row_ids(self, row: int) -> np.ndarray:
        return self.ids[self.starts[row] : self.starts[row + 1]].astype("<u4")


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> DataFrame:
    """Write shards in ascending doc_id order; returns the manifest, one row per shard with its first id's place ``base``."""
    spark = docs.sparkSession
    folder = register(spark, new_path(spark, "ids"))
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("doc_id").cast("long")
    ordered = docs.select(key.alias("doc_id"), "text").repartitionByRange(count, "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, nth = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        without_key = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal nth, without_key, held
            uri = f"{folder}/{part:06d}-{nth:05d}-{uuid.uuid4().hex}.ids"
            all_ids, all_counts, all_keys = np.concatenate(ids), np.concatenate(counts), np.concatenate(keys)
            write_bytes(uri, shard_bytes(all_ids, all_counts, all_keys, without_key))
            keyed = all_keys[without_key:]
            row = [part, nth, uri, len(all_keys), len(all_ids), int(keyed[0]) if len(keyed) else None, int(keyed[-1]) if len(keyed) else None]
            ids.clear(), counts.clear(), keys.clear()
            nth, without_key, held = nth + 1, 0, 0
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "nth", "uri", "n_docs", "n_ids", "low", "high"])

        for batch, texts in text_slices(batches, "text", CHARS_AT_ONCE):
            got, n = encoder.encode(texts)
            ends = np.cumsum(n)
            got = np.insert(got, ends, end_id)
            column = batch.column(0)
            ids.append(got), counts.append(n + 1), keys.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            without_key += column.null_count
            held += len(got)
            if held >= shard_ids:
                yield flush()
        if held:
            yield flush()

    manifest = stash(ordered.mapInArrow(run, _MANIFEST), "manifest")
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read the shards back by their keys: doc_id, start among all ids, n_tokens, unsigned crc32 of the ids, shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(read_bytes(uri))
                first = shard.find(shard.keys)
                first[: shard.without_key] = np.arange(shard.without_key)
                # a repeated key leads to its first row; the others follow it
                again = np.zeros(len(first), np.int64)
                again[1:] = first[1:] == first[:-1]
                run_start = np.maximum.accumulate(np.where(again == 0, np.arange(len(first)), 0))
                rows = first + np.arange(len(first)) - run_start
                starts, ends = shard.starts[rows], shard.starts[rows + 1]
                raw = memoryview(shard.ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                none = np.arange(len(first)) < shard.without_key
                columns = [pa.array(shard.keys[rows], mask=none), pa.array(base + starts), pa.array(ends - starts), pa.array(crcs, pa.int64()), pa.array([uri.rpartition("/")[2]] * len(crcs), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    spread = manifest.select("uri", "base").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uri")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id and ids (array<int>) of every stored row of the keys of a table; keys that aren't stored give no row.

    The parts of the writer are ranges of keys that don't overlap: their bounds, a pair for each part, go to all tasks, and
    a key finds its part by bisection. Keys and shards then meet by part, whose few shards are told apart by their bounds.
    """
    bounds = manifest.where("low IS NOT NULL").groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("low").toArrow()
    shared = manifest.sparkSession.sparkContext.broadcast(tuple(bounds.column(c).to_numpy() for c in ("part", "low", "high")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lows, highs = shared.value
        for batch in batches:
            key = batch.column(0).to_numpy()
            at = np.searchsorted(lows, key, side="right") - 1
            held = at >= 0
            held[held] = key[held] <= highs[at[held]]
            yield pa.RecordBatch.from_arrays([pa.array(key[held]), pa.array(parts[at[held]].astype(np.int32))], ["key", "part"])

    asked = keys.select(F.col("doc_id").cast("long").alias("key")).where("key IS NOT NULL").distinct().mapInArrow(place, "key long, part int")
    pairs = asked.join(manifest.select("part", "uri", "low", "high"), "part").where("key >= low AND key <= high")
    wanted = pairs.groupBy("uri").agg(F.collect_list("key").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(read_bytes(uri))
                want = np.array(want, np.int64)
                out = []
                for key, row in zip(want.tolist(), shard.find(want).tolist(), strict=True):
                    while 0 <= row < len(shard.keys) and shard.keys[row] == key:
                        out.append((key, shard.row_ids(row).tolist()))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([i for _, i in out], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return wanted.mapInArrow(run, "doc_id long, ids array<int>")
