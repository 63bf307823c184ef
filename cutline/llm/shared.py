"""Places and small Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.sources.places import drop, drop_all, new_path, register, shared_dir, stash  # noqa: F401

#: Bytes of a table, as JSON, that may be broadcast.
BROADCAST_BYTES = 24 << 20
#: No row takes fewer bytes than this.
_LEAST_ROW = 24
#: Words are what stands between blanks.
WORDS = r"[^\x20\x09-\x0D]+"


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a stashed table if its rows take at most ``most`` bytes; beyond that Spark joins by a shuffle."""
    if df.count() * _LEAST_ROW > most:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut record batches into pieces of about ``limit`` bytes of text, or one longer row; a null is an empty text."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start), [t or "" for t in texts.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += size + 1
        if start < len(texts):
            yield batch.slice(start), [t or "" for t in texts.slice(start).to_pylist()]


def write_bytes(uri: str, parts: list[bytes]) -> None:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0])
    with fs.open_output_stream(path) as out:
        for part in parts:
            out.write(part)


def read_bytes(uri: str) -> bytes:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read()
