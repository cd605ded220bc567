"""How five filters interact: a removal game per part, solved by its Hart-Mas-Colell potential.

DataFrame functions only. Every document fails some of the filters; only the numbers of documents per
part and set of failed filters, 32 sets, matter from there on. The players are the filters, and a
coalition S is worth the v(S) documents that it removes, those that fail a filter of S. The potential is

    P({}) = 0,    P(S) = (v(S) + sum over i in S of P(S without i)) / |S|

and a filter's Shapley value is P(all) - P(all without it). Computed are the whole numbers |S|! P(S).
What a filter removes at a step of an order is v(prefix with it) - v(prefix without it).
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoom.llm.base import words_of

LETTERS = "ABCDE"
COALITIONS = 1 << len(LETTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def failed_by_text(text: Column) -> Column:
    """The filters A to D that a text fails, as the sum of 1, 2, 4 and 8; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    length = F.length(text).cast("long")
    capitals = length - F.length(F.regexp_replace(text, "[A-Z]+", ""))

    def bits(words: Column) -> Column:
        n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
        tests = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n,
                 100 * capitals > MOST_CAPITALS * length, text.rlike(SYMBOLS))
        return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))

    return F.transform(F.array(words_of(text)), bits)[0]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents per part and set of failed filters, A being 1 and E 16.

    good and toxic count the documents with a label quality = 1 or toxic = 1. No text is shuffled, only
    ids, hashes and sets. Copies of a text are counted before they meet, so a text that very many
    documents share is a few rows. A null doc_id has no labels and is neither a copy nor copied.
    """
    marked = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), failed_by_text(F.col("text")).alias("failed"),
                         F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("same"))
    told = labels.groupBy(F.col("doc_id").alias("of")).agg(
        *[F.max(F.coalesce(F.col(label) == 1, F.lit(False)).cast("int")).alias(name)
          for label, name in (("quality", "good"), ("toxic", "toxic"))])
    kind = ("part", "failed", "good", "toxic")
    rows = marked.join(told, F.col("doc_id") == F.col("of"), "left").select(
        "doc_id", "same", "part", "failed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    # the rows of a doc_id are together after the join; then the rows of a text, counted where they are
    by_text = (rows.groupBy("doc_id", "same", *kind).agg(F.count("*").alias("n")).groupBy("same", *kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")))
    first = F.min("least.doc_id").over(Window.partitionBy("same"))
    original = F.col("unnamed") + F.coalesce(F.when(F.col("least.doc_id") == first, F.col("least.n")), F.lit(0))
    both = F.array(F.struct(F.col("failed").alias("failed"), F.col("original").alias("n")),
                   F.struct((F.col("failed") + COALITIONS // 2).alias("failed"), (F.col("n") - F.col("original")).alias("n")))
    return (by_text.withColumn("original", original)
            .select("part", "good", "toxic", F.inline(both))
            .groupBy("part", "failed").agg(
                F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")]))


def games(failed: DataFrame) -> DataFrame:
    """(part, n, good, toxic, v, v_good, v_toxic, potential): a row per part, arrays over all coalitions.

    n, good and toxic are by the set that exactly fails; v counts those that a coalition removes.
    """
    cells = failed.groupBy("part").agg(*[
        F.array(*[F.sum(F.when(F.col("failed") == m, F.col(c)).otherwise(0)) for m in range(COALITIONS)]).alias(c)
        for c in COUNTS])
    removed = [F.expr(f"transform(sequence(0, {COALITIONS - 1}), s -> aggregate(filter({c}, (x, i) -> (i & s) <> 0), "
                      "0L, (total, x) -> total + x))").alias(v) for c, v in zip(COUNTS, ("v", "v_good", "v_toxic"))]
    players = f"filter(sequence(0, {len(LETTERS) - 1}), i -> (s & shiftleft(1, i)) <> 0)"
    potential = F.expr(f"""aggregate(sequence(1, {COALITIONS - 1}), array(0L), (p, s) -> concat(p, array(
        factorial(bit_count(s) - 1) * v[s] + aggregate({players}, 0L, (total, i) -> total + p[s - shiftleft(1, i)]))))""")
    return cells.select("*", *removed).withColumn("potential", potential)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A row per part (language, "" for null), order of the five filters and step, zeros included. Null texts
    are empty. Rows that repeat a doc_id count each, and the first of equal texts is the one with the least
    doc_id, with all its rows. Of repeated labels any 1 counts; null labels count as 0. Other columns are
    not read. Without documents there are no rows; without labels nothing good or toxic is lost.
    """
    orders = ",".join("".join(order) for order in permutations(LETTERS))
    steps = (games(failures(docs, labels))
             .withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
             .withColumn("bit", F.expr(f"shiftleft(1, instr('{LETTERS}', substring(filter_order, step, 1)) - 1)"))
             .withColumn("done", F.expr(
                 "aggregate(filter(split(substring(filter_order, 1, step - 1), ''), x -> x <> ''), 0, "
                 f"(total, x) -> total + shiftleft(1, instr('{LETTERS}', x) - 1))")))

    def more(v: str) -> Column:
        """What the filter adds to the coalition of those before it."""
        return F.expr(f"{v}[done + bit] - {v}[done]")

    everyone = COALITIONS - 1
    return steps.select(
        "part", "filter_order", "step",
        F.expr("aggregate(n, 0L, (total, x) -> total + x) - v[done + bit]").alias("kept"),
        more("v").alias("removed"), (F.expr("v[bit]") - more("v")).alias("redundant"), F.expr("n[bit]").alias("unique_fails"),
        more("v_good").alias("good_lost"), more("v_toxic").alias("toxic_lost"),
        F.expr(f"potential[{everyone}] - {len(LETTERS)} * potential[{everyone} - bit]").alias("shapley"))


def oracle() -> str:
    """audit() for DuckDB, by applying every order to the documents, counted by what they fail."""
    tests = (f"len(words) < {LEAST_WORDS}", f"100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words)",
             f"100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(text)",
             f"regexp_matches(text, '{SYMBOLS}')", "doc_id > min(doc_id) OVER (PARTITION BY text)")
    fails = ", ".join(f"({test}) AS {letter}" for test, letter in zip(tests, LETTERS))
    by_letter = " ".join(f"WHEN '{c}' THEN {c}" for c in LETTERS)
    before = " OR ".join(f"({c} AND position('{c}' IN filter_order) < step)" for c in LETTERS)
    alone = " + ".join(f"{c}::INT" for c in LETTERS)
    letters = ", ".join(f"'{c}'" for c in LETTERS)
    distinct = " AND ".join(f"{a}.l <> {b}.l" for i, a in enumerate("vwxyz") for b in "vwxyz"[:i])
    return f"""
    WITH texts AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
      FROM documents),
    tested AS (SELECT doc_id, part, {fails} FROM texts),
    counted AS (
      SELECT part, {', '.join(LETTERS)}, count(*) AS n,
        count_if(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
        count_if(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
      FROM tested GROUP BY ALL),
    letters AS (SELECT unnest([{letters}]) AS l),
    orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order
      FROM letters v, letters w, letters x, letters y, letters z WHERE {distinct}),
    steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS own FROM orders, range(1, 6) AS t(step)),
    ran AS (SELECT *, CASE own {by_letter} END AS failed, ({before}) AS gone, {alone} = 1 AS alone FROM counted, steps),
    sums AS (
      SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (failed AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (failed AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (failed AND alone), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (failed AND NOT gone), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (failed AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM ran GROUP BY ALL)
    SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums"""
