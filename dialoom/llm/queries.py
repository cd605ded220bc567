"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import (byte_bpe, filter_audit, lattice_dedup, license_scan, mixing, near_dedup, quality, secret_scan,
                         spelling, suffix_dedup, token_counts, toxicity, url_rules)
from dialoom.llm.base import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op6_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_suffix_dedup, op2_poisson_mix, op3_toxicity, op4_token_counts, op5_quality_rules, op6_lattice_dedup,
        op7_license_scan, op8_secret_scan, op9_near_dedup, op10_byte_bpe, op11_spelling_variants, op12_url_rules,
        op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.oracle(), "op9_near_dedup": near_dedup.oracle(),
            "op2_poisson_mix": mixing.oracle(), "op5_quality_rules": quality.oracle(),
            "op6_lattice_dedup": lattice_dedup.oracle(), "op11_spelling_variants": spelling.oracle(),
            "op13_filter_audit": filter_audit.oracle()}
