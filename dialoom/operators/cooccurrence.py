"""Where the top phrases of a document stand, and how near they stand to each other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import graphs, phrases
from dialoom.operators.centrality import graph_rows, rank_rows
from dialoom.operators.common import settle, top_k
from dialoom.operators.terms import DOC, bare, keyphrase_candidates, tokenized
from dialoom.params import KeyphraseParams, RankParams
from dialoom.session import cut_lineage, stored

TASK_PLACES = 100_000    # places of phrases that one task pairs
SPAN = 1 << 17           # tokens of a document whose places meet at once


def interval_gap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Distance of the nearest positions of two runs; zero when they touch or overlap."""
    return F.greatest(start_b - end_a, start_a - end_b, F.lit(0))


def _placed(tokens: DataFrame, top: DataFrame, found: Callable[[list, list, list], list[tuple[int, int]]]) -> DataFrame:
    """(corpus, doc_id, rank, term, start, end) of the (place in the list, start) that are found in every row of tokens.

    A document's list is put beside its tokens, so no occurrence is shuffled, and only places leave the task.
    """
    @F.arrow_udf("array<struct<at:int,start:int>>")
    def places(tokens: pa.Array, terms: pa.Array, sizes: pa.Array) -> pa.Array:
        of = [found(*row) for row in zip(tokens.to_pylist(), terms.to_pylist(), sizes.to_pylist())]
        columns = np.array([place for row in of for place in row], np.int32).reshape(-1, 2).T
        rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["at", "start"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(row) for row in of])], pa.int32()), rows)

    listed = top.groupBy(*DOC).agg(F.collect_list(F.struct("term", "size", "rank")).alias("listed"))
    own, before = (["own"], F.col("before")) if "own" in tokens.columns else ([], F.lit(0))
    met = (bare(tokens).join(listed.hint("shuffle_hash"), list(DOC))
           .select(*DOC, *own, before.alias("before"), "listed", F.inline(places(
               F.coalesce("tokens", F.array().cast("array<string>")), F.col("listed.term"), F.col("listed.size")))))
    term = F.get("listed", F.col("at"))
    start = (F.col("start") + F.col("before")).cast("int")
    return (met.where("start < own") if own else met).select(
        *DOC, term["rank"].alias("rank"), term["term"].alias("term"), start.alias("start"), term["size"].alias("size"))


def phrase_positions(tokens: DataFrame, top: DataFrame,
                     params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    """(corpus, doc_id, rank, term, start, end) for every place a top phrase stands."""
    if params.position_mode == "contains":
        return _containing_positions(tokens, top)
    placed = _placed(tokens, top, lambda tokens, terms, sizes: phrases.exact_places(tokens, terms, sizes, params.remove_stopwords))
    return placed.select(*DOC, "rank", "term", "start", (F.col("start") + F.col("size") - 1).alias("end"))


def _containing_positions(tokens: DataFrame, top: DataFrame) -> DataFrame:
    """As phrase_positions, but a token matches a word that occurs inside it.

    Documents in several rows, such as segments, have places whose tokens are in two of them, so their hits meet.
    """
    length = F.size(F.split("term", "_"))

    def whole(tokens: DataFrame) -> DataFrame:
        placed = _placed(tokens, top, lambda tokens, terms, sizes: phrases.containing_places(tokens, terms))
        return placed.select(*DOC, "rank", "term", "start", (F.col("start") + length - 1).alias("end"))

    if "own" in tokens.columns:
        parts, before = tokens.withColumn("tokens", F.slice("tokens", F.lit(1), F.col("own").cast("int"))), F.col("before")
    else:
        several = cut_lineage(tokens.groupBy(*DOC).agg(F.count("*").alias("rows")).where("rows > 1").select(*DOC))
        if several.isEmpty():
            return whole(tokens)
        parts, before = tokens.join(several, list(DOC), "left_semi"), F.lit(0)
    words = top.select(*DOC, "rank", "term", F.posexplode(F.split("term", "_")).alias("at", "word"))
    listed = words.groupBy(*DOC).agg(F.collect_list(F.struct("word", "rank", "term", "at")).alias("listed"))
    # only tokens that hold a listed word leave the document
    hits = (parts.select(*DOC, "tokens", before.alias("before")).join(listed, list(DOC))
            .select(*DOC, "listed", "before", F.posexplode("tokens").alias("pos", "token"))
            .select(*DOC, (F.col("pos") + F.col("before")).alias("pos"),
                    F.inline(F.filter("listed", lambda w: F.col("token").contains(w["word"]))))
            .groupBy(*DOC, "rank", "term", (F.col("pos") - F.col("at")).alias("start"))
            .agg(F.countDistinct("at").alias("matched")))
    met = hits.where(F.col("matched") == length).select(*DOC, "rank", "term", "start", (F.col("start") + length - 1).alias("end"))
    return met if "own" in tokens.columns else met.unionByName(whole(tokens.join(several, list(DOC), "left_anti")))


def top_lists(top: DataFrame) -> DataFrame:
    """One row per document with its ranked terms; at most take_top entries each."""
    return top.groupBy(*DOC).agg(
        F.array_sort(F.collect_list(F.struct("rank", "term", "score"))).alias("top"))


def near_lists(cutoff: int, rank: Column, start: Column, end: Column, terms: Column, low: Column) -> Column:
    """The pairs of phrases of a document's places, as array<struct<src, dst, w, many>>: mean weight and number.

    Places are three arrays; terms are the document's list, in order of rank. Only places from `low` on count as second ones.
    """
    @F.arrow_udf("array<struct<src:int,dst:int,w:double,many:bigint>>")
    def near(rank: pa.Array, start: pa.Array, end: pa.Array, terms: pa.Array, low: pa.Array) -> pa.Array:
        places = [pc.list_flatten(a).to_numpy(zero_copy_only=False) for a in (rank, start, end)]
        at = np.r_[0, np.cumsum(pc.list_value_length(rank).to_numpy(zero_copy_only=False))].astype(np.int64)
        found, sizes = [], [0]
        for i, (listed, first) in enumerate(zip(terms.to_pylist(), low.to_pylist())):
            found.append(graphs.near_weights(*[a[at[i]:at[i + 1]] for a in places], listed, cutoff, first))
            sizes.append(len(found[-1][0]))
        columns = [np.concatenate(a) for a in zip(*found)] if found else [np.empty(0)] * 4
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64())
        rows = pa.StructArray.from_arrays([pa.array(a, kind) for a, kind in zip(columns, kinds)], names=["src", "dst", "w", "many"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rows)

    return near(rank, start, end, terms, low)


def near_rows(positions: DataFrame, lists: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    """(corpus, doc_id, top, near): a row for every list, with the edges between its phrases, array<struct<src, dst, w, ..>>.

    The places of a document are put beside its list, and its pairs are summed up there by one kernel call: neither
    pairs nor edges are shuffled. Documents with places beyond SPAN are cut in blocks of that, each with the
    places before it that reach into it, and the sums of the blocks meet.
    """
    span = max(SPAN, params.graph_cutoff + max(params.gram_sizes) + 1)
    # the places are read twice, and their number says how many tasks there should be
    placed = stored(positions.select(*DOC, "rank", "start", "end").where("corpus IS NOT NULL AND doc_id IS NOT NULL"), "places")
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // TASK_PLACES))

    def met(places: DataFrame, lists: DataFrame, keys: list[str], low: Column) -> DataFrame:
        held = places.repartition(parts, *keys).groupBy(*keys).agg(F.collect_list(F.struct("rank", "start", "end")).alias("held"))
        sides = [F.coalesce(F.col(f"held.{c}"), F.array().cast("array<int>")) for c in ("rank", "start", "end")]
        near = near_lists(params.graph_cutoff, *sides, F.col("top.term"), low)
        return lists.repartition(parts, *keys).join(held.hint("shuffle_hash"), keys, "left").select(*keys, "top", near.alias("near"))

    lists = lists.select(*DOC, "top")
    long = cut_lineage(placed.where(F.col("start") >= span).select(*DOC).distinct())
    if long.isEmpty():
        return met(placed, lists, list(DOC), F.lit(0))
    short = met(placed.join(long, list(DOC), "left_anti"), lists.join(long, list(DOC), "left_anti"), list(DOC), F.lit(0))
    block, reached = (F.floor(at / span) for at in (F.col("start"), F.col("end") + params.graph_cutoff))
    cut = placed.join(long, list(DOC), "left_semi").withColumn("block", F.explode(F.sequence(block, F.least(reached, block + 1))))
    lists = lists.join(long, list(DOC), "left_semi")
    blocks = met(cut, cut.select(*DOC, "block").distinct().join(lists, list(DOC)), [*DOC, "block"], F.col("block") * span)
    summed = (blocks.select(*DOC, F.inline("near")).groupBy(*DOC, "src", "dst")
              .agg((F.sum(F.col("w") * F.col("many")) / F.sum("many")).alias("w"), F.sum("many").alias("many"))
              .groupBy(*DOC).agg(F.collect_list(F.struct("src", "dst", "w", "many")).alias("near")))
    return short.unionByName(lists.join(summed, list(DOC), "left"))


def cooccurrence_edges(positions: DataFrame, lists: DataFrame,
                       params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    """(corpus, doc_id, src, dst, w, top): mean log nearness of two phrases; src, dst are ranks in the list `top`."""
    return near_rows(positions, lists, params).select(*DOC, "top", F.inline("near")).drop("many")


def scored_edges(edges: DataFrame) -> DataFrame:
    """Edge weights times the scores of both phrases in the list beside; weights not above zero drop out."""
    src, dst = F.get("top", F.col("src") - 1), F.get("top", F.col("dst") - 1)
    return (edges.where("w > 0")
            .select(*DOC, "dst", "src", (F.col("w") * src["score"] * dst["score"]).alias("w"),
                    src["term"].alias("src_term"), dst["term"].alias("dst_term"))
            .where("w > 0"))


def scored_rows(rows: DataFrame) -> DataFrame:
    """As scored_edges, of rows of near_rows(): (corpus, doc_id, top, edges), nodes numbered from 0."""
    @F.arrow_udf("array<struct<src:int,dst:int,w:double>>")
    def scored(near: pa.Array, score: pa.Array) -> pa.Array:
        sizes, listed = (pc.list_value_length(a).to_numpy(zero_copy_only=False) for a in (near, score))
        src, dst, w = (pc.list_flatten(near).field(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "w"))
        first = np.repeat(np.cumsum(listed) - listed, sizes) - 1
        scores = pc.list_flatten(score).to_numpy(zero_copy_only=False)
        total = w * scores[first + src] * scores[first + dst]
        kept = (w > 0) & (total > 0)
        ends = np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(sizes)]]
        rows = pa.StructArray.from_arrays([pa.array(a[kept], kind) for a, kind in (
            (src - 1, pa.int32()), (dst - 1, pa.int32()), (total, pa.float64()))], names=["src", "dst", "w"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    near = F.coalesce("near", F.array().cast("array<struct<src:int,dst:int,w:double,many:bigint>>"))
    return rows.select(*DOC, "top", scored(near, F.col("top.score")).alias("edges"))


def keyphrase_edges(docs: DataFrame, params: KeyphraseParams = KeyphraseParams(),
                    top: DataFrame | None = None, tokens: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """(corpus, doc_id, src, dst, src_term, dst_term, w) of every document's phrase graph.

    packed: a row per document with its list, (corpus, doc_id, top, edges), as its graph wants them.
    """
    tokens = tokenized(docs, params, keep=True) if tokens is None else tokens
    top = cut_lineage(keyphrase_candidates(docs, params, tokens=tokens)) if top is None else top
    positions = phrase_positions(tokens, top, params)
    if packed:
        return scored_rows(near_rows(positions, top_lists(top), params))
    return scored_edges(cooccurrence_edges(positions, top_lists(top), params))


def keyphrase_graphs(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per document: (top, n, edges), nodes numbered by statistical rank.

    Packed edges have a document's list beside them and need not meet it.
    """
    if "edges" in edges.columns:
        return edges.select(*DOC, "top", F.size("top").alias("n"), "edges")
    numbered = edges.select(*DOC, (F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"), "w")
    return graph_rows(lists.withColumn("n", F.size("top")), numbered, DOC)


def rank_keyphrases(graphs: DataFrame, params: KeyphraseParams = KeyphraseParams(),
                    ranking: RankParams = RankParams()) -> DataFrame:
    """(corpus, doc_id, rank, term, score): phrases by their place in the graph."""
    keys = [*DOC, "top"]
    ranked = rank_rows(graphs, keys, params.measure, ranking).select(
        *DOC, F.col("top")[F.col("node")]["term"].alias("term"), F.col("rank").alias("score"),
        F.col("node").alias("stat_rank"))
    return top_k(ranked, DOC, [settle(F.col("score")).desc(), "stat_rank"], params.take_top
                 ).drop("stat_rank")
