"""Sentence vectors, sentence graphs and the choice of summary sentences.

Sentences are numbered 0.. in first-seen order within their document (`pos`).
All work stays within a document, whose rows are spread once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text as tx
from dialoom.operators.common import parallel, settle, spread_text
from dialoom.operators.terms import DOC
from dialoom.params import SummaryParams

SENT = (*DOC, "pos")
BLOCK_SENTENCES = 512    # sentences of either side that meet in one product
TASK_TERMS = 300_000     # words of sentences that one task packs


def distinct_sentences(docs: DataFrame) -> DataFrame:
    """(corpus, doc_id, pos, sentence, n_sentences); a repeated sentence counts once."""
    found = F.array_distinct(tx.sentences(F.col("text")))
    return (spread_text(parallel(docs, *DOC).select(*DOC, "text"), docs, *DOC)
            .select(*DOC, found.alias("found"))
            .select(*DOC, F.size("found").alias("n_sentences"),
                    F.posexplode("found").alias("pos", "sentence")))


def sentence_weights(sentences: DataFrame) -> DataFrame:
    """(corpus, doc_id, pos, term, df, w): TF-IDF of content words, idf within the document."""
    words = F.explode(tx.tokenize(tx.normalize_text(F.col("sentence")))).alias("term")
    counted = (sentences.select(*SENT, "n_sentences", words).where(~tx.is_stop("term"))
               .groupBy(*SENT, "n_sentences", "term").agg(F.count("*").alias("tf")))
    df = F.count("*").over(Window.partitionBy(*DOC, "term"))
    idf = F.ln((1 + F.col("n_sentences")) / (1 + F.col("df"))) + 1
    return counted.withColumn("df", df).select(*SENT, "term", "df", (F.col("tf") * idf).alias("w"))


def unit_vectors(weights: DataFrame) -> DataFrame:
    """(corpus, doc_id, pos, term, df, w, u) with u of length one per sentence."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*SENT)))
    return weights.withColumn("u", F.col("w") / norm)


def _measured(a: tuple, b: tuple, least: float) -> tuple[np.ndarray, ...]:
    """(src, dst, w) of the pairs from least on of two blocks (pos, term's number, u), src < dst."""
    terms, codes = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
    sides = []
    for (pos, _, u), code in zip((a, b), np.split(codes, [len(a[1])])):
        found, row = np.unique(pos, return_inverse=True)
        matrix = np.zeros((len(found), len(terms)))
        matrix[row, code] = u
        sides.append((found, matrix))
    (src, left), (dst, right) = sides
    w = left @ right.T
    i, j = np.nonzero((w >= least) & (w > 0) & (src[:, None] < dst[None, :]))
    return src[i], dst[j], w[i, j]


def similar_sentences(vectors: DataFrame, threshold: float, lie_together: bool = False) -> DataFrame:
    """(corpus, doc_id, src, dst, w): every pair with cosine at or above the threshold.

    Exact. The sentences of a document are packed into blocks, spread by document, and every pair of its
    blocks is one product of two matrices within a task; only pairs that reach the threshold leave it.
    Vectors that lie together by document are read as they lie.
    """
    spread = vectors.select(*DOC, "pos", "term", "u")
    if not lie_together:
        parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // TASK_TERMS))
        spread = spread.repartition(parts, *DOC)
    blocks = (spread
              .groupBy(*DOC, F.floor(F.col("pos") / BLOCK_SENTENCES).alias("block"))
              .agg(F.collect_list(F.struct("pos", "term", "u")).alias("held")))

    def side(name: str) -> DataFrame:
        return blocks.select(*DOC, F.col("block").alias(name), F.col("held").alias(f"{name}_held"))

    met = side("a").join(side("b"), list(DOC)).where("a <= b").select(*DOC, *[
        F.col(f"a_held.{c}").alias(f"a_{c}") for c in ("pos", "term", "u")], *[
        F.when(F.col("a") < F.col("b"), F.col(f"b_held.{c}")).alias(f"b_{c}") for c in ("pos", "term", "u")])
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c in batch.schema.names[len(DOC):]}
            words = [pc.list_flatten(lists[c]) for c in ("a_term", "b_term")]
            codes = pa.concat_arrays(words).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            sides = []
            for side, code in zip("ab", np.split(codes, [len(words[0])])):
                sizes = pc.fill_null(pc.list_value_length(lists[f"{side}_pos"]), 0).to_numpy(zero_copy_only=False)
                pos, u = (pc.list_flatten(lists[f"{side}_{c}"]).to_numpy(zero_copy_only=False) for c in ("pos", "u"))
                sides.append(list(zip(*[np.split(x, np.cumsum(sizes)[:-1]) for x in (pos, code, u)])))
            alone = lists["b_pos"].is_null().to_pylist()
            found = [_measured(a, a if one else b, threshold - 1e-8) for a, b, one in zip(*sides, alone)]
            if not found:
                continue
            row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            keys = [batch.column(c).take(pa.array(row)) for c in DOC]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(np.concatenate(x)) for x in zip(*found))], names=[*DOC, "src", "dst", "w"])

    schema = f"corpus {types['corpus']}, doc_id {types['doc_id']}, src {types['pos']}, dst {types['pos']}, w double"
    return met.mapInArrow(pairs, schema).where(settle(F.col("w")) >= threshold)


def graph_sizes(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy(*DOC).agg(F.max("n_sentences").alias("n"))


def ranked_sentences(sentences: DataFrame, ranks: DataFrame, p: SummaryParams) -> DataFrame:
    """(corpus, doc_id, pos, sentence, score, rank): every sentence, the best first."""
    # ranks meet their document as one row, so sentences that lie together by document are not shuffled
    listed = ranks.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("node", "rank")))["rank"].alias("ranks"))
    scored = sentences.join(listed.hint("shuffle_hash"), list(DOC)).withColumn("rank", F.get("ranks", "pos")).where("rank IS NOT NULL").select(
        *SENT, "sentence", (F.col("rank") * tx.sentence_length_weight(
            F.col("sentence"), p.length_threshold)).alias("score"))
    return in_order_of_score(scored)


def in_order_of_score(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy(*DOC).orderBy(settle(F.col("score")).desc(), "pos")
    return scored.withColumn("rank", F.row_number().over(order))


def _similarities(leads: list[dict], pos: np.ndarray, term: np.ndarray, w: np.ndarray, u: np.ndarray, p: SummaryParams) -> np.ndarray:
    """Cosines of the sums of the first n leads (rank, pos) to the document, min_sentences to max_sentences of them."""
    sizes = np.arange(p.min_sentences, p.max_sentences + 1)
    terms, code = np.unique(term, return_inverse=True)
    whole = np.bincount(code, w, len(terms))
    length = np.sqrt(whole @ whole)
    leads = sorted(leads, key=lambda lead: lead["rank"])
    led = np.array([lead["pos"] for lead in leads], np.int64)
    found, at = np.unique(led, return_inverse=True)
    kept = np.isin(pos, found)
    vectors = np.zeros((len(found), len(terms)))
    np.add.at(vectors, (np.searchsorted(found, pos[kept]), code[kept]), u[kept])
    vectors = vectors[at]
    # the squared length of a sum of vectors is the sum of all their products
    products = vectors @ vectors.T
    near = np.r_[0.0, np.cumsum(vectors @ whole)]
    square = np.r_[0.0, np.cumsum(np.diag(products) + 2 * np.triu(products, 1).sum(axis=0))]
    many = np.searchsorted([lead["rank"] for lead in leads], sizes, "right")
    within = np.sqrt(square[many]) * length
    return np.divide(near[many], within, out=np.zeros(len(sizes)), where=within > 0)


def candidate_similarity(vectors: DataFrame, ranked: DataFrame, p: SummaryParams) -> DataFrame:
    """(corpus, doc_id, n, similarity) of the n leading sentences' mean to the document.

    Lists of min_sentences to max_sentences are tried, of the ranked sentences of any number. The vectors of a
    document meet its leading sentences once, and one kernel call serves every n.
    """
    @F.arrow_udf("array<double>")
    def similarities(leads: pa.Array, pos: pa.Array, term: pa.Array, w: pa.Array, u: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.list_value_length(pos).to_numpy(zero_copy_only=False))[:-1]
        codes = pc.dictionary_encode(pc.list_flatten(term), null_encoding="encode").indices
        columns = [codes, *(pc.list_flatten(a) for a in (pos, w, u))]
        code, place, weight, unit = (np.split(a.to_numpy(zero_copy_only=False), ends) for a in columns)
        out = [_similarities(*row, p) for row in zip(leads.to_pylist(), place, code, weight, unit)]
        return pa.array(out, pa.list_(pa.float64()))

    tried = F.when(F.col("rank") <= p.max_sentences, F.struct("rank", "pos"))
    leads = ranked.groupBy(*DOC).agg(F.collect_list(tried).alias("leads"))
    held = vectors.groupBy(*DOC).agg(F.collect_list(F.struct("pos", "term", "w", "u")).alias("held"))
    empty = {"pos": "int", "term": "string", "w": "double", "u": "double"}
    sides = [F.coalesce(F.col(f"held.{c}"), F.array().cast(f"array<{kind}>")) for c, kind in empty.items()]
    return (leads.join(held, list(DOC), "left").select(*DOC, F.posexplode(similarities("leads", *sides)).alias("at", "similarity"))
            .select(*DOC, (F.col("at") + p.min_sentences).alias("n"), "similarity"))


def loss_column(n: Column, similarity: Column, penalty: float) -> Column:
    return (1 - similarity) * (1 - similarity) + penalty * n


def summary_lengths(similarity: DataFrame, p: SummaryParams) -> DataFrame:
    """(corpus, doc_id, n, loss): the first length with the least loss."""
    loss = similarity.withColumn("loss", loss_column(F.col("n"), F.col("similarity"), p.penalty))
    least = F.min_by(F.struct("n", "loss"), F.struct(settle(F.col("loss")), F.col("n"))).alias("least")
    return loss.groupBy(*DOC).agg(least).select(*DOC, "least.n", "least.loss")


def chosen_sentences(ranked: DataFrame, lengths: DataFrame, p: SummaryParams) -> DataFrame:
    """(corpus, doc_id, ord, pos, sentence, score), ord counting in the wanted order."""
    order = ["pos"] if p.order_by_occurrence else ["rank"]
    chosen = ranked.join(lengths.select(*DOC, "n"), list(DOC)).where("rank <= n")
    return chosen.select(*DOC, F.row_number().over(Window.partitionBy(*DOC).orderBy(*order)).alias("ord"),
                         "pos", "sentence", "score")
