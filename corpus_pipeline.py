"""The corpus pipeline: language ID, exact dedup, near-dedup, source mixing, best-fit packing, each over all that came before.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and read again as the docs of the next one. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import exact_dedup, language_id, mixing, packing, similar
from brindle.llm.base import new_path, table

#: No source is passed over more often than this, and every source at least once.
REPETITION_LIMIT = 1.5

#: Bytes of text encoded together by a task: fewer than when packing runs alone, as executors hold memory of earlier stages.
ENCODED_AT_ONCE = 1 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go: their language can't be told."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose 5-word shingles are similar by 0.8 or more, directly or by others, the one with the smallest id stays."""
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources repeat towards equal weights. The budget lets every document stay, so none is lost to the mixture."""
    return mixing.resample(docs, repetition_limit=REPETITION_LIMIT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(docs, at_once=ENCODED_AT_ONCE)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Components of similar texts, temperature bisection and packing are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
