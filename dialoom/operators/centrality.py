"""Centrality of many graphs at once: nodes (keys, node), edges (keys, src, dst, w), src < dst.

Nodes of a group are numbered 0..n-1. Graphs are independent, so each is ranked
by one kernel call in a task. A graph with more edges than allowed there is ranked
by joins and aggregations over the cluster instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import graphs
from dialoom.operators.common import join_dimension
from dialoom.params import RankParams, check_measure
from dialoom.session import bucketed, cut_lineage, stored


#: Sources whose paths one task follows in a large graph.
SOURCES = 64


def rank_column(measure: str, p: RankParams, n: Column, src: Column, dst: Column, w: Column) -> Column:
    """Ranks of one graph's nodes, as an array, from its edge arrays."""
    check_measure(measure)

    @F.arrow_udf("array<double>")
    def rank(n: pa.Array, src: pa.Array, dst: pa.Array, w: pa.Array) -> pa.Array:
        sizes = n.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(src).to_numpy(zero_copy_only=False))[:-1]
        a, b, weight = (np.split(pc.list_flatten(x).to_numpy(zero_copy_only=False).astype(kind), ends)
                        for x, kind in ((src, np.int64), (dst, np.int64), (w, np.float64)))
        if measure == "pagerank":
            out = [graphs.pagerank(*graph, p) for graph in zip(sizes.tolist(), a, b, weight)]
        else:
            out = graphs.path_centralities(sizes.tolist(), a, b, [1.0 / x if p.invert else x for x in weight], measure == "load centrality")
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in out])], pa.int32()), pa.array(np.concatenate([[], *out])))

    return rank(n, src, dst, w)


def graph_rows(sizes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per graph: (keys, n, edges). Only for graphs of bounded size."""
    packed = edges.groupBy(*keys).agg(F.collect_list(F.struct("src", "dst", "w")).alias("edges"))
    empty = F.array().cast("array<struct<src:int,dst:int,w:double>>")
    return (sizes.join(packed, list(keys), "left")
            .withColumn("edges", F.coalesce(F.col("edges"), empty)))


def rank_rows(rows: DataFrame, keys: Sequence[str], measure: str, p: RankParams) -> DataFrame:
    """(keys, node, rank) from graph rows."""
    ranks = rank_column(measure, p, F.col("n"), F.col("edges.src"), F.col("edges.dst"), F.col("edges.w"))
    return (rows.where("n > 0").select(*keys, ranks.alias("ranks"))
            .select(*keys, F.posexplode("ranks").alias("node", "rank")))


def centrality(sizes: DataFrame, edges: DataFrame, keys: Sequence[str], measure: str = "pagerank",
               p: RankParams = RankParams()) -> DataFrame:
    """(keys, node, rank) for graphs of any size; sizes holds (keys, n)."""
    keys = list(keys)
    # the kernel of PageRank holds nodes as it holds edges, in lists; those of path measures have matrices
    most = max(p.max_group_nodes, p.max_group_edges) if measure == "pagerank" else p.max_group_nodes
    edges = stored(edges.select(*keys, F.col("src").cast("int"), F.col("dst").cast("int"), "w"), "edges")
    many = edges.groupBy(*keys).agg(F.count("*").alias("m")).where(F.col("m") > p.max_group_edges)
    large = cut_lineage(many.select(*keys).unionByName(
        sizes.where(F.col("n") > most).select(*keys)).distinct())
    if large.isEmpty():
        return rank_rows(graph_rows(sizes, edges, keys), keys, measure, p)
    small = rank_rows(graph_rows(sizes.join(large, keys, "left_anti"),
                                 edges.join(large, keys, "left_anti"), keys), keys, measure, p)
    by_parts = pagerank_by_rounds if measure == "pagerank" else (
        lambda *graphs_of: path_measure_by_sources(*graphs_of, measure=measure))
    return small.unionByName(by_parts(
        sizes.join(large, keys, "left_semi"), edges.join(large, keys, "left_semi"), keys, p))


def path_measure_by_sources(sizes: DataFrame, edges: DataFrame, keys: Sequence[str], p: RankParams,
                            measure: str) -> DataFrame:
    """Betweenness or load of large graphs: every task follows the paths of one block of sources.

    A task holds the edges of its graph as lists, and the parts of a node are summed. So a graph's
    edges must fit a task, but neither its number of nodes squared nor all its work.
    """
    keys = list(keys)

    @F.pandas_udf("array<double>")
    def carried(n: pd.Series, first: pd.Series, src: pd.Series, dst: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for size, start, a, b, weight in zip(n, first, src, dst, w):
            weight = np.asarray(weight, dtype=np.float64)
            out.append(graphs.path_centrality(
                size, np.asarray(a, np.int64), np.asarray(b, np.int64), 1.0 / weight if p.invert else weight,
                measure == "load centrality", start, SOURCES))
        return pd.Series(out)

    blocks = (graph_rows(sizes.where("n > 0"), edges, keys)
              .withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1, F.lit(SOURCES))))
              .repartition(*keys, "first"))
    parts = blocks.select(*keys, carried(
        F.col("n"), F.col("first"), F.col("edges.src"), F.col("edges.dst"), F.col("edges.w")).alias("parts"))
    return (parts.select(*keys, F.posexplode("parts").alias("node", "part"))
            .groupBy(*keys, "node").agg(F.sum("part").alias("rank")))


def pagerank_by_rounds(sizes: DataFrame, edges: DataFrame, keys: Sequence[str],
                       p: RankParams = RankParams()) -> DataFrame:
    """PageRank of graphs too large for one task: a join and an aggregation per round.

    Every round is checkpointed, so plans stay short and a lost executor costs
    at most one round. The links lie in buckets by node, so a round shuffles nodes and not links.
    """
    keys = list(keys)
    both = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("to"), "w").unionByName(
        edges.select(*keys, F.col("dst").alias("node"), F.col("src").alias("to"), "w"))
    out = both.groupBy(*keys, "node").agg(F.sum("w").alias("out"))
    table = bucketed(both.select(*keys, "node", "to", "w"), "links", *keys, "node")
    links = edges.sparkSession.table(table)
    nodes = (sizes.where("n > 0")
             .select(*keys, "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("node"))
             .join(out, [*keys, "node"], "left")
             .select(*keys, "node", "n", "out", (1 / F.col("n")).alias("rank"), F.lit(False).alias("done")))
    state = cut_lineage(nodes)
    for _ in range(p.rounds if p.rounds is not None else p.max_rounds):
        flow = (links.join(state.select(*keys, "node", "rank", "out").hint("shuffle_hash"), [*keys, "node"])
                .groupBy(*keys, F.col("to").alias("node"))
                .agg(F.sum(F.col("rank") * (F.col("w") / F.col("out"))).alias("flow")))
        lost = state.groupBy(*keys).agg(
            F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0)).alias("lost"))
        new = (F.lit(p.damping) * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / F.col("n"))
               + (1 - p.damping) / F.col("n"))
        moved = join_dimension(state.join(flow, [*keys, "node"], "left"), lost, keys).select(
            *keys, "node", "n", "out", "done", F.col("rank").alias("old"),
            F.when(F.col("done"), F.col("rank")).otherwise(new).alias("rank"))
        if p.rounds is not None:
            state = cut_lineage(moved.drop("old"))
            continue
        moved = cut_lineage(moved)
        settled = moved.groupBy(*keys).agg(
            (F.sum(F.abs(F.col("rank") - F.col("old"))) < F.first("n") * p.tolerance).alias("settled"))
        state = cut_lineage(join_dimension(moved.drop("old"), settled, keys)
                            .withColumn("done", F.col("done") | F.col("settled")).drop("settled"))
        if state.where(~F.col("done")).isEmpty():
            break
    edges.sparkSession.sql(f"DROP TABLE {table}")  # the rounds are written
    return state.select(*keys, "node", "rank")
