"""The corpus pipeline: quality rules, near-dedup, secrets, mixing, tokens.

Stages take documents with any further columns, whatever their names, and keep them up to the last stage.
An empty table gives no rows. Before a stage is called, the result of the one before has to be written; the
tables that it was made from, but for any that docs still reads, are removed then.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import byte_bpe, mixing, near_dedup, quality, secret_scan
from dialoom.llm.base import read, remove_tables, written

#: Least similarity, in hundredths, of near-duplicates in the near-dedup stage; op9_near_dedup has its own.
NEAR_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No SQL engine expresses the byte-pair stage; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, among them null and empty texts; null ids and repeated rows are judged alike."""
    return quality.good_documents(docs)


def near_dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the least doc_id, nulls last; those without words all stay."""
    remove_tables(spark, but=(docs,))
    return near_dedup.one_of_each(docs, NEAR_PERCENT)


def secret_scan_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, n_chars follows; no row goes, null texts stay null."""
    remove_tables(spark, but=(docs,))
    return secret_scan.redacted(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source, null as one more, gets an equal share of the text, by repeating documents; rows are shuffled."""
    remove_tables(spark, but=(docs,))
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every row and decode it again; a null text is empty."""
    remove_tables(spark, but=(docs,))
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup_documents),
    ("secret_scan", secret_scan_masked), ("mixing", mixed_sources), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
