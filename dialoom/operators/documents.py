"""From script lines to documents: one per episode, one per leading character."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text as tx
from dialoom.operators.common import join_dimension, top_k

SEGMENT_LINES = 1000


def ordered_segments(rows: DataFrame, keys: Sequence[str], order: str, value: Column,
                     glue: str = " ", length: int | None = None) -> DataFrame:
    """(keys, segment, text, first): values joined in order, a bounded run of them per segment.

    `order` must be unique within a key. Segments are ranges of `length` of it, so even a
    key holding most rows is joined by many tasks.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return (rows.groupBy(*keys, F.floor(F.col(order) / (length or SEGMENT_LINES)).alias("segment"))
            .agg(F.array_join(F.transform(packed, lambda x: x["v"]), glue).alias("text"),
                 F.min(order).alias("first")))


def ordered_join(rows: DataFrame, keys: Sequence[str], order: str, value: Column,
                 glue: str = " ") -> DataFrame:
    """(keys, text, first): all values of a key in order, joined by way of segments."""
    packed = F.array_sort(F.collect_list(F.struct("segment", "text")))
    return (ordered_segments(rows, keys, order, value, glue).groupBy(*keys)
            .agg(F.array_join(F.transform(packed, lambda x: x["text"]), glue).alias("text"),
                 F.min("first").alias("first")))


def episode_documents(lines: DataFrame) -> DataFrame:
    """(show, episode, text, first) of the punctuated lines, in order."""
    return ordered_join(lines, ["show", "episode"], "line_no", tx.punctuate(F.col("line")))


def episode_order(lines: DataFrame) -> DataFrame:
    """(show, episode, first_line): distinct episodes; sort by first_line for first-seen order."""
    return lines.groupBy("show", "episode").agg(F.min("line_no").alias("first_line"))


def season_index(lines: DataFrame) -> DataFrame:
    """(show, season_key, episode, first_line), with the key "All" beside each season."""
    episodes = lines.groupBy("show", "season", "episode").agg(F.min("line_no").alias("first_line"))
    keyed = episodes.select("show", "episode", "first_line", F.explode(
        F.array(F.lit("All"), F.col("season").cast("string"))).alias("season_key"))
    return keyed.groupBy("show", "season_key", "episode").agg(F.min("first_line").alias("first_line"))


def top_speakers(lines: DataFrame, n: int = 50, removed: Sequence[str] = ("", "MAN"),
                 settings: DataFrame | None = None) -> DataFrame:
    """(show, character_name, n_lines, first_line, rank): most lines first, then first seen.

    settings (show, num_characters, remove_names) has what single shows want otherwise; a show that is not
    there, or a null, takes n and removed.
    """
    counted = lines.groupBy("show", "character_name").agg(
        F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))
    order = [F.col("n_lines").desc(), F.col("first_line")]
    if settings is None:
        return top_k(counted.where(~F.col("character_name").isin(*removed)), ["show"], order, n)
    usual = F.array(*[F.lit(name) for name in removed]).cast("array<string>")
    own = join_dimension(counted, settings.select("show", "num_characters", "remove_names"), ["show"], "left").where(
        ~F.array_contains(F.coalesce("remove_names", usual), F.col("character_name")))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("show").orderBy(*order)))
    return ranked.where(F.col("rank") <= F.coalesce("num_characters", F.lit(n))).drop("num_characters", "remove_names")


def leading_lines(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    return join_dimension(lines, speakers.select("show", "character_name"),
                          ["show", "character_name"], "left_semi")


def character_documents(lines: DataFrame, n: int = 50, removed: Sequence[str] = ("", "MAN"),
                        settings: DataFrame | None = None) -> DataFrame:
    """(show, character_name, text, first) for the leading speakers of each show."""
    leading = leading_lines(lines, top_speakers(lines, n, removed, settings))
    return ordered_join(leading, ["show", "character_name"], "line_no", tx.punctuate(F.col("line")))
