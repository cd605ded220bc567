"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.base import written

MOST_ROUNDS = 60


def _star(edges: DataFrame, keep) -> DataFrame:
    """Each node's chosen neighbours are hung below the least of its neighbourhood."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (edges.join(least, "u").where(keep)
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
    return row["n"], row["h"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(u, component) for every node of edges (u, v): the least node it is connected with.

    Nodes are longs; repeated edges, loops and either direction are fine; no edges, no rows. Every
    round is two aggregations and joins over at most as many edges as came in, and its result is
    written to the shared folder. The number of rounds grows with the logarithm of the graph.
    """
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        if mark[0] == 0:
            break
        large = _star(_both_ways(edges), "v > u OR v = m").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = written(small, "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return edges.select("u", F.col("v").alias("component")).union(tops).distinct()
