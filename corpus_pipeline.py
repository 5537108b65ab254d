"""The corpus pipeline: documents through five operators, each stage's result written and read again.

Stages get every row their predecessor kept and decide on all of them. All but the last return the columns of
``documents``, whatever they are called. The order of rows carries no meaning but after mixing, where it is the shuffled
order of each partition.

Edge cases: null and empty texts fail the base of the quality rules; rows without an id all stay past near-duplicates unless
their texts are equal; each text of an id with several is decided on alone; texts that suffix dedup empties stay as
documents; an empty table, or one of which nothing is kept, gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm import minhash, mixing, packing, quality_rules, suffix_dedup
from lakemill.llm.common import latest, release, table, written, written_so_far
from lakemill.llm.queries import tokenizer


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; cutoffs are learned from the labels."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least id."""
    return minhash.kept_documents(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur more than once go; the documents stay."""
    return suffix_dedup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated towards the target weights of their sources and shuffled."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and offset."""
    return packing.packing(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good),
    ("minhash_dedup", single),
    ("suffix_dedup", unrepeated),
    ("mixing", mixed),
    ("packing", packed),
]

#: Exact binomial bounds, near-duplicate components and tokenizer ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way, and the stage before, goes as soon as its result is written."""
    df, kept = table(spark, sf_dir, "documents"), 0
    for name, stage in STAGES:
        since = written_so_far()
        df = written(stage(spark, df, sf_dir), f"stage_{name}")
        release(since - kept, keep=latest())
        kept = 1
    return df
