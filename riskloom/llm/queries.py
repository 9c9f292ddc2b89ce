"""The registered queries of this subpackage and their DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import collocations, decontam, exact_dedup, licenses, packing, quality, secret_scan, simhash, substring_dedup, token_order, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_order.training_order(table(spark, sf_dir, "documents"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("leaked")


def op5_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op11_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.summary(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op12_vertical_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weak_toxicity": op1_weak_toxicity,
    "op2_randomness_secrets": op2_randomness_secrets,
    "op3_training_order": op3_training_order,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_quality_nbsvm": op5_quality_nbsvm,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash_pivots": op8_simhash_pivots,
    "op9_warc_index": op9_warc_index,
    "op10_license_rules": op10_license_rules,
    "op11_difference_cover": op11_difference_cover,
    "op12_vertical_phrases": op12_vertical_phrases,
    "op13_block_whitening": op13_block_whitening,
}
ORACLE: dict[str, str] = {
    "op4_template_decontamination": decontam.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op9_warc_index": warc.SQL,
    "op11_difference_cover": substring_dedup.SQL,
    "op12_vertical_phrases": collocations.SQL,
}
