"""Nearest neighbours by cosine: exact in blocks of queries and rows, and through an index of lists around centroids.

Blocks. Rows and queries are dealt into blocks by a hash of their key; each block of queries meets each block of rows in
one task as two matrices, and only the best of each query leave it. No vector passes through the driver, and the plan is
the same whatever the number of queries. Products are taken in one order for each row, so equal vectors get equal values.

Index. Centroids are fitted by spherical k-means to a bounded sample, the ``SAMPLE`` rows of the least hash; every row
goes to the list of its nearest centroid, and the lists are stored. Queries read the lists of their ``probes`` nearest
centroids and rank what they find there exactly; how many that is follows from the sample, by the share of its rows'
neighbours that so many lists hold. A list is cut into parts by a hash of the key, each a task's work, so a
list that holds a third of all rows is many parts.

Vectors of length 0, null vectors and those of another size than the first one have no neighbours and are none's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.sources.places import stash

#: Rows and queries in a block, on average.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 512
#: Rows that centroids are fitted to at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
#: Rows of the sample whose neighbours say how many lists to read, and the share of neighbours that these have to hold.
ASKED, RECALL = 500, 0.95


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one size as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of a with all rows of b; equal rows get equal values, which BLAS doesn't promise."""
    return np.einsum("ij,kj->ik", a, b)


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    square = lambda x: np.einsum("ij,ij->i", x, x)
    return products(queries, rows) / np.sqrt(np.outer(square(queries), square(rows)))


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has a length, no null in it and the most frequent size."""
    square = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = df.where(F.col(vector).isNotNull() & (square > 0))  # null and NaN fail too
    size = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(size), F.size(vector) == F.col("n")).drop("n")  # one row


def _best(values: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the k highest values of each row, ties by the lower key."""
    k = min(k, values.shape[1])
    edge = np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k, None] if k else np.zeros((len(values), 1))
    row, place = np.nonzero(values >= edge)
    order = np.lexsort((keys[place], -values[row, place], row))
    row, place = row[order], place[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], place[nth < k]


def _in_blocks(rows: DataFrame, queries: DataFrame, key: str, query: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the number of a block of rows and one of queries, each side once for each block of the other."""
    n_rows, n_queries = (max(1, -(-df.count() // size)) for df, size in ((rows, BLOCK_ROWS), (queries, BLOCK_QUERIES)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", of(key, n_rows).alias("__r"), every(n_queries).alias("__q"))
    right = queries.select(F.col(query).alias("__id"), F.col("embedding").alias("__v"), of(query, n_queries).alias("__q"), every(n_rows).alias("__r"))
    return left, right


def _products_by_block(left: DataFrame, right: DataFrame, by: Sequence[str], take: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(take, schema)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _nearest_of(key: str, query: str, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def take(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        keys, ids = rows.column(key), queries.column("__id")
        out: list[pa.Table] = []
        if len(rows) and len(queries):
            values = cosines(matrix(queries.column("__v")), matrix(rows.column("embedding")))
            order = np.argsort(np.array(keys.to_pylist(), object), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            row, place = _best(values, rank, k)
            out.append(pa.table({query: ids.take(pa.array(row)), key: keys.take(pa.array(place)), "similarity": values[row, place]}))
        return out[0] if out else pa.table({query: ids.slice(0, 0), key: keys.slice(0, 0), "similarity": pa.array([], pa.float64())})

    return take


def nearest(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query: str = "query_id") -> DataFrame:
    """The k nearest chunks of each query, exactly: query, key, similarity, rank (ties: the lower key)."""
    rows, asked = usable(chunks.select(key, "embedding")), usable(queries.select(query, "embedding"))
    left, right = _in_blocks(rows, asked, key, query)
    found = _products_by_block(left, right, ["__r", "__q"], _nearest_of(key, query, k), f"{query} {_kind(queries, query)}, {key} {_kind(chunks, key)}, similarity double")
    return _ranked(found, query, key, k)


def _ranked(found: DataFrame, query: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of_groups(chunks: DataFrame, queries: DataFrame, group: str, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """The highest similarity of each group's chunks to each query: query, group, similarity. Each block sends one row for each of its groups."""
    rows, asked = usable(chunks.select(key, group, "embedding")), usable(queries.select(query, "embedding"))
    left, right = _in_blocks(rows, asked, key, query)

    def take(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        kind, ids = rows.schema.field(group).type, queries.column("__id")
        coded = rows.column(group).combine_chunks().dictionary_encode(null_encoding="encode") if len(rows) else None
        if coded is None or not len(queries):
            return pa.table({query: ids.slice(0, 0), group: pa.array([], kind), "similarity": pa.array([], pa.float64())})
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary)))
        best = np.maximum.reduceat(cosines(matrix(queries.column("__v")), matrix(rows.column("embedding")))[:, order], starts, axis=1)
        q, g = np.divmod(np.arange(best.size), best.shape[1])
        return pa.table({query: ids.take(pa.array(q)), group: coded.dictionary.take(pa.array(g)), "similarity": best.ravel()})

    found = _products_by_block(left, right, ["__r", "__q"], take, f"{query} {_kind(queries, query)}, {group} {_kind(chunks, group)}, similarity double")
    return found.groupBy(query, group).agg(F.max("similarity").alias("similarity"))


class VectorIndex(NamedTuple):
    """lists: the stored rows (key, embedding, list, part); parts: list and n_parts; centroids: a row for each list; probes: how many to read."""

    lists: DataFrame
    parts: DataFrame
    centroids: np.ndarray
    probes: int
    key: str


def fit_centroids(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample; a centroid that loses all its rows keeps its place."""
    unit = sample / np.sqrt(np.einsum("ij,ij->i", sample, sample))[:, None]
    found = unit[np.linspace(0, len(unit) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = (unit @ found.T).argmax(1)
        total = np.zeros_like(found)
        np.add.at(total, own, unit)
        size = np.sqrt((total**2).sum(1))
        found[size > 0] = total[size > 0] / size[size > 0, None]
    return found


def enough_probes(sample: np.ndarray, centroids: np.ndarray, k: int = 10, share: float = RECALL) -> int:
    """The least number of lists that hold ``share`` of the k nearest in the sample of some of its rows."""
    unit = sample / np.sqrt(np.einsum("ij,ij->i", sample, sample))[:, None]
    own = (unit @ centroids.T).argmax(1)
    asked = unit[np.linspace(0, len(unit) - 1, min(ASKED, len(unit))).astype(int)]
    near = np.argsort(-(asked @ unit.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], 1), share, method="higher")) + 1


def build_index(chunks: DataFrame, key: str = "chunk_id", lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The stored index of all chunks (key, embedding). lists: by default the square root of the rows, 4096 at most."""
    rows = usable(chunks.select(key, "embedding"))
    count = rows.count()
    n = max(1, min(lists or int(count**0.5), 4096, count))
    # only the sample comes to the driver, of at most ``sample`` rows whatever the size of the table
    held = rows.orderBy(F.xxhash64(key), key).limit(max(sample, n)).select("embedding").toArrow()
    seen = matrix(held.column(0))
    centroids = fit_centroids(seen, n) if count else np.zeros((0, 1))
    probes = enough_probes(seen, centroids) if count else 0
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(centroids)

    def place(batches):
        for batch in batches:
            vectors = matrix(batch.column(1))
            own = products(vectors, shared.value).argmax(1) if len(vectors) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [key, "embedding", "list"])

    placed = rows.mapInArrow(place, f"{key} {_kind(chunks, key)}, embedding {_kind(chunks, 'embedding')}, list int")
    placed = stash(placed, "placed")
    parts = stash(placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_parts")), "list_parts")
    dealt = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64(key), F.col("n_parts")).cast("int")).drop("n_parts")  # 4096 rows at most
    return VectorIndex(stash(dealt.repartition("list", "part").sortWithinPartitions("list", "part"), "lists"), parts, centroids, probes, key)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, query: str = "query_id") -> DataFrame:
    """The k nearest of the rows in each query's ``probes`` nearest lists: query, key, similarity, rank."""
    probes = index.probes if probes is None else probes
    asked = usable(queries.select(query, "embedding"))
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    key = index.key

    def probe(batches):
        for batch in batches:
            vectors = matrix(batch.column(1))
            near = np.argsort(-products(vectors, shared.value), axis=1, kind="stable")[:, :probes] if len(vectors) and len(shared.value) else np.zeros((len(batch), 0), np.int64)
            rows = np.repeat(np.arange(len(batch)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(near.ravel().astype(np.int32))], ["__id", "__v", "list"])

    wanted = asked.mapInArrow(probe, f"__id {_kind(queries, query)}, __v {_kind(queries, 'embedding')}, list int")
    # queries of a list are dealt out as well, so that a list in demand is no single task's work
    wanted = stash(wanted, "probes")
    sizes = wanted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("n_asks")).join(index.parts, "list")
    right = wanted.join(sizes, "list").select("__id", "__v", "list", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), F.pmod(F.xxhash64("__id"), F.col("n_asks")).cast("int").alias("ask"))
    left = index.lists.join(sizes, "list").select(key, "embedding", "list", "part", F.explode(F.sequence(F.lit(0), F.col("n_asks") - 1)).alias("ask"))
    found = _products_by_block(left, right, ["list", "part", "ask"], _nearest_of(key, query, k), f"{query} {_kind(queries, query)}, {key} {_kind(index.lists, key)}, similarity double")
    return _ranked(found, query, key, k)


def recall(found: DataFrame, exact: DataFrame, query: str, key: str) -> Column | float:
    """The share of the exact neighbours that were found; the last of equals may stand for each other."""
    return found.select(query, key).join(exact.select(query, key), [query, key]).count() / max(1, exact.count())
