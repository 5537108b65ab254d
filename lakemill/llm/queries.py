"""The queries of this subpackage, opN_<name>(spark, sf_dir), and their SQL where DuckDB can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language_id, minhash, mixing, oracle, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filter
from .common import remove_at_exit, shared_dir, table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs of pages whose title is symbol junk; other spellings of such a URL are caught by its canonical form."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)", 1)
    return url_filter.url_filter(pages, pages.where(title.rlike(r"\*\*\*|%%%|###")).select("url"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing(table(spark, sf_dir, "documents"), tokenizer())


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first, so that a run's cost is that of counting everything."""
    cache = f"{shared_dir(spark)}/lakemill/token_cache-{uuid.uuid4().hex}"
    remove_at_exit(cache)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer(), cache)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1,
        "op2_quality_classifier": op2,
        "op3_fingerprints": op3,
        "op4_suffix_dedup": op4,
        "op5_url_filter": op5,
        "op6_language_id": op6,
        "op7_packing": op7,
        "op8_minhash_dedup": op8,
        "op9_mixing": op9,
        "op10_token_counts": op10,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
