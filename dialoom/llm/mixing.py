"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source is to supply a given share of all text. Its mean repetition rate is that share over the
share it has; every document appears a Poisson number of times with that mean. The number comes
from inverting the distribution at a uniform hash of (seed, doc_id, length of the text), or of the text
itself where the doc_id is null. So it depends on no other row, on no partitioning, and comes out the
same when a lost task is run again; rows with equal ids and lengths draw alike. A rate above
MOST_RATE, whose distribution would begin below what a double can hold, is cut into equal pieces; the
number is the sum of their draws, each with a hash of its own.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.base import unit_hash, written

SEED = 20
#: Below this, what is left of a distribution's tail is no longer seen by a 52-bit hash.
TAIL_SIGMAS, TAIL_REST = 10, 30
#: exp(-MOST_RATE) is still a normal double.
MOST_RATE = 700


def uniform_weights(docs: DataFrame) -> DataFrame:
    """(source, weight): every source, null included as one more, gets the same weight."""
    return docs.select("source").distinct().withColumn("weight", F.lit(1.0))


def rates(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, rate): mean repetitions that bring each source to its weight's share of the text.

    Text is measured in characters. Sources without a weight, with a weight of 0 or without text
    get rate 0; weights need not add up to 1. The mix has as much text as docs on average.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    wanted = weights.groupBy("source").agg(F.sum("weight").alias("weight"))
    both = (sizes.alias("s").join(wanted.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left")
            .select("s.source", F.coalesce("chars", F.lit(0)).alias("chars"),
                    F.when(F.coalesce("chars", F.lit(0)) > 0, F.greatest("weight", F.lit(0.0)))
                    .otherwise(0.0).alias("weight")))
    total = both.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars")
    return both.crossJoin(F.broadcast(total)).select(  # total is one row
        "source", F.coalesce(F.when(F.col("weight") > 0, share), F.lit(0.0)).alias("rate"))


def distribution(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ..., as far as a hash can tell it from 1."""
    most = F.ceil(rate + TAIL_SIGMAS * F.sqrt(rate)).cast("int") + TAIL_REST
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("upto"))
    return F.aggregate(
        F.sequence(F.lit(1), most), start,
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(
            s["upto"], F.array(F.element_at(s["upto"], -1) + s["p"] * rate / k)).alias("upto")),
        lambda s: s["upto"])


def pieces(rate: Column) -> Column:
    """How many equal pieces of at most MOST_RATE a rate is drawn in."""
    return F.greatest(F.ceil(rate / MOST_RATE), F.lit(1)).cast("int")


def _name() -> Column:
    """What a row is hashed by: its doc_id, or without one its text."""
    return F.coalesce(F.col("row.doc_id").cast("string"), F.concat(
        F.lit("text "), F.md5(F.coalesce(F.col("row.text"), F.lit("")))))


def counted(docs: DataFrame, rated: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, copies): rows of docs with their draw at the rate that rated (source, rate) has for the source."""
    sources = written(rated.select(
        F.col("source").alias("of"), pieces(F.col("rate")).alias("pieces"),
        distribution(F.col("rate") / pieces(F.col("rate"))).alias("upto")), "distributions")
    rows = docs.select(F.struct("*").alias("row"))
    parts = (F.lit(seed), _name(), F.length("row.text"))
    drawn = rows.withColumn("draw", unit_hash(*parts)).join(
        sources, F.col("row.source").eqNullSafe(F.col("of")), "left")

    def count(draw: Column) -> Column:
        return F.size(F.filter("upto", lambda c: c <= draw))

    draws = F.transform(F.sequence(F.lit(1), F.col("pieces") - 1), lambda i: unit_hash(*parts, i))
    further = F.aggregate(draws, F.lit(0), lambda n, draw: n + count(draw))
    count_all = count(F.col("draw")) + F.when(F.col("pieces") > 1, further).otherwise(0)
    return drawn.select("row", F.when(F.col("upto").isNull(), 0).otherwise(count_all).alias("copies"))


def replicated(docs: DataFrame, weights: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, copy, place): rows of docs, each as often as its draw says; copy counts from 0.

    The distributions, a row per source, are written first, so that their size is known when the
    join is planned: below its size limit Spark broadcasts them and no text is shuffled for it.
    """
    return (counted(docs, rates(docs, weights), seed)
            .where(F.col("copies") > 0)
            .select("row", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
            .withColumn("place", F.md5(F.concat_ws(
                ":", F.lit(seed).cast("string"), _name(), F.col("copy").cast("string")))))


def shuffled(mixed: DataFrame) -> DataFrame:
    """Rows dealt out by a hash and put in hash order within each part: a global shuffle."""
    return mixed.repartition("place").sortWithinPartitions("place")


def mixed_rows(docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """docs mixed to the weights (source, weight) and shuffled globally, with the columns of docs only.

    Weights are equal by default. Null texts have length 0 for the shares; a null source is one more
    source; null ids and repeated rows are drawn each by their hash. Columns may have any names; an empty
    table gives no rows.
    """
    return shuffled(replicated(docs, uniform_weights(docs) if weights is None else weights, seed)).select("row.*")


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """As mixed_rows(), with `copy` (which repetition of the document) and `place` (a hash) beside docs.

    Reading in the order of place gives the shuffled order. Columns of these names in docs are replaced.
    """
    mixed = shuffled(replicated(docs, uniform_weights(docs) if weights is None else weights, seed))
    own = [f"row.`{c}`" for c in docs.columns if c not in ("copy", "place")]
    return mixed.select(*own, "copy", "place")


def oracle(seed: int = SEED) -> str:
    """mix() with equal weights, for DuckDB."""
    return f"""
    WITH RECURSIVE sizes AS (
      SELECT source, sum(length(text)) AS chars FROM documents GROUP BY source),
    weighted AS (
      SELECT source, coalesce(chars, 0) AS chars, CASE WHEN coalesce(chars, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS weight
      FROM sizes),
    rated AS (
      SELECT source, CASE WHEN weight > 0 THEN
          weight / sum(weight) OVER () * sum(chars) OVER ()::DOUBLE / chars ELSE 0 END AS rate FROM weighted),
    upto AS (
      SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rated
      UNION ALL
      SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM upto
      WHERE k < ceil(rate + {TAIL_SIGMAS} * sqrt(rate)) + {TAIL_REST}),
    drawn AS (
      SELECT d.*, ('0x' || substr(md5('{seed}:' || doc_id || ':' || length(text)), 1, 13))::BIGINT / {float(1 << 52)} AS draw
      FROM documents d),
    counted AS (
      SELECT drawn.doc_id, count(*) AS n FROM drawn JOIN upto USING (source)
      WHERE c <= draw GROUP BY drawn.doc_id)
    SELECT d.*, r::INTEGER AS copy, md5('{seed}:' || doc_id || ':' || r) AS place
    FROM documents d JOIN counted USING (doc_id), unnest(range(n)) AS t(r)"""


def most_copies(rate: float) -> int:
    """The largest count a draw at this rate can give."""
    n = max(ceil(rate / MOST_RATE), 1)
    return n * (ceil(rate / n + TAIL_SIGMAS * sqrt(rate / n)) + TAIL_REST)
