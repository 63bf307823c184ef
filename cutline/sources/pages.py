"""Glyph tables read by ranges of pages: one partition for each range, so memory follows the range and not the book."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import GLYPHS

#: Pages that a task reads.
CHUNK = 40


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, chunk: int, wanted: list[int] | None):
        self.path, self.chunk, self.wanted = path, chunk, wanted

    def partitions(self) -> list[Pages]:
        """Ranges of the pages there are, from the page column's statistics alone where files have them."""
        low, high = None, None
        for fragment in ds.dataset(self.path, format="parquet").get_fragments():
            for group in fragment.row_groups:
                bounds = (group.statistics or {}).get("page") or pc.min_max(fragment.subset(row_group_ids=[group.id]).to_table(columns=["page"]).column(0)).as_py()
                if bounds.get("min") is not None:
                    low = bounds["min"] if low is None else min(low, bounds["min"])
                    high = bounds["max"] if high is None else max(high, bounds["max"])
        if low is None:
            return [Pages(0, -1)]
        starts = range(low, high + 1, self.chunk)
        ranges = [Pages(a, min(a + self.chunk - 1, high)) for a in starts]
        return [r for r in ranges if self.wanted is None or any(r.first <= p <= r.last for p in self.wanted)] or [Pages(0, -1)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        kept = (ds.field("page") >= partition.first) & (ds.field("page") <= partition.last)
        if self.wanted is not None:
            kept = kept & ds.field("page").isin(self.wanted)
        names = [c.split()[0] for c in GLYPHS.split(", ")]
        for batch in ds.dataset(self.path, format="parquet").to_batches(columns=names, filter=kept, batch_size=8192, batch_readahead=1, fragment_readahead=1):
            if batch.num_rows:
                yield batch


class GlyphPages(DataSource):
    """Format ``glyph_pages``. Options: path; chunk, pages in a partition; pages, numbers with commas, to read no others."""

    @classmethod
    def name(cls) -> str:
        return "glyph_pages"

    def schema(self) -> str:
        return GLYPHS

    def reader(self, schema) -> DataSourceReader:
        pages = self.options.get("pages")
        return _Reader(self.options["path"], int(self.options.get("chunk", CHUNK)), [int(p) for p in pages.split(",")] if pages else None)


def glyph_pages(spark: SparkSession, path: str, pages: list[int] | None = None, chunk: int = CHUNK):
    """The glyphs of a Parquet file or folder, by ranges of ``chunk`` pages; with ``pages`` those only."""
    spark.dataSource.register(GlyphPages)
    reader = spark.read.format("glyph_pages").option("path", path).option("chunk", chunk)
    return (reader.option("pages", ",".join(map(str, pages))) if pages else reader).load()
