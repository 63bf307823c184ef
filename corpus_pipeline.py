"""The corpus pipeline: from raw documents to token ids, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import decontam, langid, neardup, pii, word_bpe
from cutline.llm.queries import remainder, tokenizer
from cutline.llm.shared import stash


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and one language with a fair share of them stay."""
    return langid.keep_known(docs, langid.train(docs, remainder(4) != 2))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near-duplicate documents the one of the least doc_id stays."""
    return neardup.without_near_duplicates(docs)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item stay."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data and terms that give it away are replaced, n_chars follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the SHA-256 of what they decode to."""
    path = tokenizer("word_bpe_49k.json")
    found = word_bpe.encode(docs, path, word_bpe.build_lexicon(docs, path))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", free_of_benchmarks),
    ("pii", sanitised),
    ("bpe", encoded),
]

#: SQL can't express the trained language model of the first stage; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
