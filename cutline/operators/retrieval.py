"""Vector and keyword retrieval, their fusion, chunking of marked-up text, and incremental indexing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that carry no meaning in a keyword query.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def terms(text: Column) -> Column:
    """Lower-case words without stop words and without a plural or verb ending."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.transform(kept, lambda w: F.when(F.length(w) > 5, F.regexp_replace(w, "(ing|ed|es|s)$", "")).otherwise(w))


def keyword_hits(chunks: DataFrame, query_terms: Sequence[str], k: int, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """Chunks that hold every term, ranked by the sum of log(1 + count): key, score, rank. No terms: no hits."""
    words = terms(F.col(text))
    wanted = list(dict.fromkeys(query_terms))
    counts = [F.size(F.filter("__w", _same(t))) for t in wanted]
    if not wanted:
        return chunks.select(key, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    rows = chunks.select(key, words.alias("__w")).select(key, *(c.alias(f"__n{i}") for i, c in enumerate(counts)))
    held = rows
    for i in range(len(wanted)):
        held = held.where(F.col(f"__n{i}") > 0)
    score = sum((F.log1p(F.col(f"__n{i}").cast("double")) for i in range(1, len(wanted))), F.log1p(F.col("__n0").cast("double")))
    top = held.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def _same(term: str):
    return lambda w: w == term


def fuse(vector: DataFrame, keyword: DataFrame, key: str, top: int = 5, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: key, rrf, place; ties go to the vector list's order."""
    a = vector.select(key, F.col("rank").alias("a"))
    b = keyword.select(key, F.col("rank").alias("b"))
    share = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (F.lit(k) + F.col(c))).otherwise(0.0)
    fused = a.join(b, key, "full").select(key, "a", "b", (share("a") + share("b")).alias("rrf"))
    order = [F.desc("rrf"), F.asc_nulls_last("a"), F.asc_nulls_last("b"), F.asc(key)]
    best = fused.orderBy(*order).limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("a", "b")


def fuse_each(vector: DataFrame, keyword: DataFrame, query: str, key: str, top: int = 5, k: int = 60) -> DataFrame:
    """``fuse`` for each query of two ranked tables (query, key, rank): query, key, rrf, place."""
    a = vector.select(query, key, F.col("rank").alias("a"))
    b = keyword.select(query, key, F.col("rank").alias("b"))
    share = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (F.lit(k) + F.col(c))).otherwise(0.0)
    fused = a.join(b, [query, key], "full").withColumn("rrf", share("a") + share("b"))
    order = Window.partitionBy(query).orderBy(F.desc("rrf"), F.asc_nulls_last("a"), F.asc_nulls_last("b"), F.asc(key))
    return fused.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("a", "b")


def title(content: Column, fallback: Column) -> Column:
    """The first H1 line, or the fallback."""
    found = F.trim(F.regexp_extract(content, r"(?m)^# (.*)$", 1))
    return F.when(content.rlike(r"(?m)^# "), found).otherwise(fallback)


def chunks(documents: DataFrame, key: str, text: str, most: int = 2000, carry: Sequence[str] = ()) -> DataFrame:
    """Sections at H2, long ones packed by paragraph: key, the columns to carry, idx, heading, content."""
    sections = F.filter(F.transform(F.split(text, r"\n(?=## )"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")

    def parts(s: Column) -> Column:
        headed = s.startswith("## ")
        heading = F.when(headed, F.trim(F.regexp_extract(s, r"^## ([^\n]*)", 1)))
        body = F.when(headed, F.regexp_replace(F.regexp_replace(s, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")).otherwise(s)
        paragraphs = F.filter(F.transform(F.split(body, r"\n\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

        def pack(done: Column, p: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))
            fits = F.coalesce(F.length(last) + F.length(p) + 2 <= most, F.lit(False))
            grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), p)))
            return F.when(fits, grown).otherwise(F.concat(done, F.array(p)))

        packed = F.when(F.length(body) <= most, F.array(body)).otherwise(F.aggregate(paragraphs, F.array().cast("array<string>"), pack))
        return F.transform(F.filter(packed, lambda b: b != ""), lambda b: F.struct(heading.alias("heading"), b.alias("content")))

    rows = documents.select(key, *carry, F.posexplode(F.flatten(F.transform(sections, parts))).alias("idx", "c"))
    return rows.select(key, *carry, "idx", "c.heading", "c.content")


def reindex(old_index: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """The new state of an index of chunks: documents of the same hash keep their rows, others are cut anew.

    old_index: key, content_hash, idx, heading, content, tokens. Documents that are gone lose their chunks.
    """
    now = documents.select(key, text, F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash"))
    same = old_index.join(now.select(key, "content_hash"), [key, "content_hash"], "left_semi")
    fresh = now.join(old_index.select(key, "content_hash").distinct(), [key, "content_hash"], "left_anti")
    cut = chunks(fresh, key, text, carry=["content_hash"])
    tokens = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")).cast("long")
    return same.unionByName(cut.withColumn("tokens", tokens).select(*old_index.columns))
