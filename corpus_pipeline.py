"""A training corpus from the documents: quality rules, near-duplicates, benchmark leaks, then tokens.

Every stage's rows are written as Parquet below the shared folder and read again by the next. Stages work on all that
the one before kept; null and repeated rows are as the operators define them.
"""

from __future__ import annotations

from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession

from tidegrove.llm import bpe, decontaminate, near_copies, quality
from tidegrove.llm.queries import RANKS
from tidegrove.llm.shared import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. A doc_id that rows share is kept row by row, as the verdict goes with the text."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id; rows of one doc_id are told apart."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own text holds no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded again."""
    return bpe.round_trip(docs, RANKS, PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]
#: SQL can't express fingerprints, singular vectors or the merges of tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
