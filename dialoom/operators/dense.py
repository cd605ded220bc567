"""Sentences as given dense vectors: links above a threshold, and similarity of growing summaries.

Sentences of a document are numbered densely (node), so that blocks of them have a bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.operators.terms import DOC
from dialoom.params import SummaryParams

BLOCK_ROWS = 1024     # vectors measured together in one kernel call


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def directions(vectors: DataFrame) -> DataFrame:
    """Rows with `v` of length one; vectors without a direction (null, zero, not finite) drop out."""
    v = F.col("v").cast("array<double>")
    rest = [c for c in vectors.columns if c != "v"]
    return (vectors.select(*rest, v.alias("v")).withColumn("length", F.sqrt(product(F.col("v"), F.col("v"))))
            .where((F.col("length") > 0) & (F.col("length") < float("inf")))
            .select(*rest, F.transform("v", lambda x: x / F.col("length")).alias("v")))


def similar_dense(vectors: DataFrame, threshold: float) -> DataFrame:
    """(corpus, doc_id, src, dst, w) of all pairs with cosine at or above the threshold, from (.., node, v).

    Each document is cut into blocks of BLOCK_ROWS nodes, and each pair of blocks is one product of two
    matrices: no task gets a whole document, and no pair below the threshold leaves a task.
    """
    unit = directions(vectors.select(*DOC, "node", "v"))
    blocks = unit.groupBy(*DOC).agg((F.floor(F.max("node") / BLOCK_ROWS) + 1).alias("blocks"))
    own = F.floor(F.col("node") / BLOCK_ROWS)
    # a block is the left side for itself and all later ones, and the right side for all earlier ones
    dealt = (unit.join(blocks, list(DOC)).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select(*DOC, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "v"))

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        first = rows.iloc[0]
        left, right = (rows[rows["own"] == first[side]] for side in ("x", "y"))
        if left.empty or right.empty:
            i = j = w = np.empty(0)
        else:
            w = np.round(np.vstack(left["v"].to_list()) @ np.vstack(right["v"].to_list()).T, 12)
            a, b = left["node"].to_numpy(), right["node"].to_numpy()
            at = np.nonzero((np.round(w, 9) >= threshold) & (a[:, None] < b[None, :]))
            i, j, w = a[at[0]], b[at[1]], w[at]
        return pd.DataFrame({"corpus": first["corpus"], "doc_id": first["doc_id"], "src": i, "dst": j, "w": w}).astype(
            {"src": "int32", "dst": "int32", "w": "float64"})

    kinds = {f.name: f.dataType.simpleString() for f in unit.schema}
    return dealt.groupBy(*DOC, "x", "y").applyInPandas(
        linked, f"corpus {kinds['corpus']}, doc_id {kinds['doc_id']}, src int, dst int, w double")


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """(corpus, doc_id, v): the mean of each document's vectors, summed up by place before anything is shuffled."""
    return (vectors.where("v IS NOT NULL").select(*DOC, F.posexplode(F.col("v").cast("array<double>")).alias("at", "x"))
            .groupBy(*DOC, "at").agg(F.avg("x").alias("x"))
            .groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("at", "x")))["x"].alias("v")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no direction or a place without a number."""
    found = product(a, b) / (F.sqrt(product(a, a)) * F.sqrt(product(b, b)))
    return F.when(F.isnan(found) | found.isNull(), 0.0).otherwise(found)


def summary_similarity(vectors: DataFrame, documents: DataFrame, ranked: DataFrame, p: SummaryParams) -> DataFrame:
    """(corpus, doc_id, n, similarity) of the n leading sentences' mean to the document's vector.

    At most max_sentences vectors of a document come together. Sums grow by one vector at a time.
    """
    leading = (ranked.where(F.col("rank") <= p.max_sentences).select(*DOC, "pos", "rank")
               .join(vectors.select(*DOC, "pos", F.col("v").cast("array<double>").alias("v")), [*DOC, "pos"])
               .where("v IS NOT NULL")
               .groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("leading")))
    whole = documents.select(*DOC, F.col("v").cast("array<double>").alias("whole"))
    start = F.struct(F.transform("whole", lambda x: F.lit(0.0)).alias("sum"),
                     F.array().cast("array<struct<rank:int,sum:array<double>>>").alias("sums"))

    def grown(done: Column, x: Column) -> Column:
        more = F.zip_with(done["sum"], x["v"], lambda a, b: a + b)
        return F.struct(more.alias("sum"), F.concat(done["sums"], F.array(F.struct(
            x["rank"].cast("int").alias("rank"), more.alias("sum")))).alias("sums"))

    sums = F.aggregate("leading", start, grown, lambda done: done["sums"])
    sized = (ranked.select(*DOC).distinct().join(whole, list(DOC), "left").join(leading, list(DOC), "left")
             .withColumn("sums", sums)
             .withColumn("n", F.explode(F.sequence(F.lit(p.min_sentences), F.lit(p.max_sentences)))))
    last = F.element_at(F.filter("sums", lambda s: s["rank"] <= F.col("n")), -1)["sum"]
    return sized.withColumn("last", F.when(F.exists("sums", lambda s: s["rank"] <= F.col("n")), last)).select(
        *DOC, "n", cosine(F.col("last"), F.col("whole")).alias("similarity"))
