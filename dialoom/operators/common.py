"""Join and ranking helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


NUMBERED = 4096       # places numbered together
TASK_TEXT = 1_000_000  # characters of text whose terms one task counts; they take some hundred times as much memory
MET_TEXT = 8_000_000   # characters of text whose distinct terms meet in one task


def parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over all cores by key; a scan may have too few splits for the work that follows."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key at full parallelism.

    The count is explicit so that adaptive execution does not merge the
    partitions: the rows are small, but the work on each is not.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread_text(df: DataFrame, docs: DataFrame, *keys: str) -> DataFrame:
    """As spread_by, in as many parts as the text of the docs asks for, so that the work of a task does
    not grow with the table. The text is measured beforehand, in one pass that moves nothing.
    """
    return df.repartition(text_parts(docs, TASK_TEXT), *keys)


def text_parts(docs: DataFrame, chars: int) -> int:
    """How many parts leave so many characters of the docs' text to each; no fewer than the session's shuffles have."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // chars))


def join_dimension(facts: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-key lookup whose keys may be very hot in the facts.

    Adaptive execution decides while it runs: it broadcasts a lookup only below the session's
    size limit, and splits the partitions of hot keys otherwise. Nothing is counted beforehand.
    """
    return facts.join(dim, list(keys), how)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """Rank within each key and keep k. Spark limits each task's groups before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def settle(score: Column) -> Column:
    """Score rounded so that ties do not hang on the last bits of a logarithm."""
    return F.round(score, 9)


def numbered(rows: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Number the rows of each key from 0 in their order, which is a distinct whole number per row.

    Ranges of the order are counted, the counts are summed up, and rows are numbered within their
    range: a key that holds most rows is numbered by many tasks.
    """
    ranged = rows.withColumn("range", F.floor(F.col(order) / NUMBERED))
    before = F.sum("many").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranged.groupBy(*keys, "range").agg(F.count("*").alias("many")).withColumn("before", before)
    own = F.row_number().over(Window.partitionBy(*keys, "range").orderBy(order)) - 1
    return (ranged.withColumn(name, own).join(ranges.select(*keys, "range", "before"), [*keys, "range"])
            .withColumn(name, (F.coalesce("before", F.lit(0)) + F.col(name)).cast("int")).drop("range", "before"))
