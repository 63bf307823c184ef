"""Vectors of texts by a given callable, once for each different text and at a pace that all tasks share.

Texts are known by their SHA-256. Those that the store holds are not sent again; the others are sent once each, in
batches. Before a batch's vectors leave the task they are written to a file of the batch's own, so when a task is lost or
the job fails and is run again, the batches that were done are read and not paid for twice. Rows are dealt to
``parallel`` tasks by hash, each of which waits ``parallel * delay`` seconds between calls: together they make at most
one call in ``delay`` seconds, whatever the size of the cluster.

Null and empty texts have no vector. A callable that gives another number of vectors than it got texts is an error.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
_VECTORS = "content_hash string, embedding array<float>"
_SCHEMA = pa.schema([("content_hash", pa.string()), ("embedding", pa.list_(pa.float32()))])


def _kept(uri: str) -> pa.Table | None:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
        return None
    with fs.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all()


def _keep(uri: str, table: pa.Table) -> None:
    """Under its name only once it is whole."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0])
    with fs.open_output_stream(f"{path}.part") as f, pa.ipc.new_file(f, _SCHEMA) as out:
        out.write_table(table)
    fs.move(f"{path}.part", path)


def _missing(df: DataFrame, path: str) -> DataFrame:
    try:
        held = df.sparkSession.read.schema(_VECTORS).parquet(path)
    except Exception as e:  # the first call has no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return df
    return df.join(held.select("content_hash"), "content_hash", "left_anti")


def embed(docs: DataFrame, key: str, text: str, call: Embed, store: str, batch: int = 32, parallel: int = 2, delay: float = 0.0) -> DataFrame:
    """key, content_hash and embedding of each row; ``store`` is a folder that all executors reach, as a URI."""
    hashed = docs.select(key, text, F.when(F.col(text) != "", F.sha2(text, 256)).alias("content_hash"))
    texts = hashed.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.first(text).alias("text"))
    todo = _missing(texts, f"{store}/vectors").repartition(parallel, "content_hash").sortWithinPartitions("content_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[str] = []
        said: list[str] = []
        last = 0.0

        def out() -> pa.RecordBatch:
            nonlocal last
            uri = f"{store}/batches/{hashlib.sha256(','.join(hashes).encode()).hexdigest()}.arrow"
            found = _kept(uri)
            if found is None:
                time.sleep(max(0.0, last + parallel * delay - time.monotonic()) if last else 0.0)
                last = time.monotonic()
                vectors = call(said)
                if len(vectors) != len(said):
                    raise ValueError(f"{len(said)} texts gave {len(vectors)} vectors")
                found = pa.table({"content_hash": hashes, "embedding": vectors}, schema=_SCHEMA)
                _keep(uri, found)
            hashes.clear(), said.clear()
            return found.combine_chunks().to_batches()[0]

        for part in batches:
            for h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                hashes.append(h)
                said.append(t)
                if len(hashes) == batch:
                    yield out()
        if hashes:
            yield out()

    todo.select("content_hash", "text").mapInArrow(run, _VECTORS).write.mode("append").parquet(f"{store}/vectors")
    vectors = docs.sparkSession.read.schema(_VECTORS).parquet(f"{store}/vectors").dropDuplicates(["content_hash"])
    return hashed.select(key, "content_hash").join(vectors, "content_hash", "left").select(key, "content_hash", "embedding")
