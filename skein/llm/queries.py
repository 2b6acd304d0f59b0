"""Queries of the training-data operators over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import avi, decontaminate, license_scan, mixing, quality, simhash, substring_dedup, suffix_tree_lm, token_files, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_digest(_table(spark, sf_dir, "documents"))


def op5_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_digest(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digest(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_digest(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    settings = token_files.TokenFiles(public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_digest(_table(spark, sf_dir, "documents"), settings)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_license_scan, op2_decontamination, op3_quality_classifier, op4_suffix_tree_lm, op5_avi_media, op6_simhash, op7_url_filter, op8_source_mixing, op9_token_files, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle_sql(),
        "op2_decontamination": decontaminate.ORACLE_SQL,
        "op7_url_filter": url_filter.ORACLE_SQL,
        "op8_source_mixing": mixing.ORACLE_SQL,
        "op10_substring_dedup": substring_dedup.ORACLE_SQL,
    }
