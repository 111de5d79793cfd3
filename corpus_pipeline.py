"""The corpus pipeline: five stages, each a function of the documents its predecessor kept.

Every function takes (spark, docs, sf_dir) and gives a DataFrame; all but the last return the columns of `documents`.
Stages are written as Parquet and read again between each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from staffscope.llm import byte_bpe, exact_dedup, mixing, quality, similar
from staffscope.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or are probably bad go."""
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts one document stays."""
    index = exact_dedup.DigestIndex(spark)
    try:
        return exact_dedup.keep_new(docs, index)
    finally:
        index.close()


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: five words a shingle, similarity 0.8 or more."""
    return similar.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids (`ids`, array of int) and the number of them; encoded, not yet decoded."""
    return byte_bpe.encoded(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte-level BPE", encode)]

#: The estimation of the rules and the groups of near-duplicates are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
