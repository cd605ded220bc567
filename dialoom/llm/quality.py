"""Quality by weak supervision: rules vote or abstain, EM finds how far to trust each.

DataFrame functions only. The votes of all documents are counted per pattern of votes (at most
3 ** len(RULES) patterns, whatever the input), and expectation-maximisation runs on those counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.base import words_of, written

WINDOW = 8
ROUNDS = 12
PRIOR = 0.9
TRUST = 0.8
SMOOTHING = 1.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_capitals", "n_plain", "n_ended")
PLAIN_WORD = r"""^["'(]*[\p{L}\p{M}'’-]+[.,;:!?)"']*\z"""
LINE_END = r"""[.!?:;"')][\x20\x09-\x0D]*\z"""

#: Each rule as conditions under which it votes against and for a document; else it abstains.
#: The conditions are whole-number SQL, read alike by any engine.
RULES = (
    ("symbols", "10 * n_symbols > 3 * n_words", "50 * n_symbols <= n_words"),
    ("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("lines", "100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
    ("word_length", "2 * word_chars < 5 * n_words OR word_chars > 14 * n_words",
     "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    ("capitals", "100 * n_capitals > 40 * word_chars", "100 * n_capitals <= 15 * word_chars"),
    ("plain_words", "10 * n_plain < 6 * n_words", "10 * n_plain >= 8 * n_words"),
    ("line_ends", "2 * n_ended < n_lines", "10 * n_ended >= 7 * n_lines"),
    ("length", "n_words < 30", "n_words >= 50"),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _neighbours(values: Column, step: int, combine: Callable[[Column, Column], Column]) -> Column:
    return _let(values, lambda v: F.zip_with(
        v, F.slice(v, F.lit(step + 1), F.size(v)), combine))


def repeated_words(words: Column) -> Column:
    """Words covered by WINDOW-word windows that the text holds twice or more.

    A window's hash is built from halves: of 2, 4, then 8 words. Equal windows stand side by side
    once sorted by (hash, place); what sorted places cover is summed up in one pass.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = _neighbours(hashes, step, lambda a, b: F.xxhash64(a, b))
    windows = F.slice(hashes, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))

    def covered(of: Column) -> Column:
        placed = F.sort_array(F.transform(of, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = F.flatten(_neighbours(placed, 1, lambda a, b: F.when(
            a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
        places = F.sort_array(F.array_distinct(twice))
        steps = _neighbours(places, 1, lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    return _let(windows, lambda of: F.when(
        F.size(F.array_distinct(of)) == F.size(of), F.lit(0).cast("long")).otherwise(covered(of)))


def measured(docs: DataFrame) -> DataFrame:
    """docs with one more column, a struct `_quality` of the counts all rules use.

    Null texts count as empty. docs has no columns `_quality`, `_words` or `_lines` of its own.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    capitals = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
    return (docs.withColumn("_words", words_of(F.col("text"))).withColumn("_lines", lines)
            .withColumn("_quality", F.struct(
                F.size("_words").cast("long").alias("n_words"),
                F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")
                .alias("n_symbols"),
                (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
                .alias("n_dup_lines"),
                repeated_words(F.col("_words")).alias("n_repeat_words"),
                F.size("_lines").cast("long").alias("n_lines"),
                (F.length(text) - F.length(capitals)).cast("long").alias("n_capitals"),
                F.size(F.filter("_words", lambda w: w.rlike(PLAIN_WORD))).cast("long").alias("n_plain"),
                F.size(F.filter("_lines", lambda line: line.rlike(LINE_END))).cast("long")
                .alias("n_ended")))
            .drop("_words", "_lines"))


def _in_counts(condition: str) -> str:
    for name in COUNTS:
        condition = condition.replace(name, f"_quality.{name}")
    return condition


def votes() -> list[Column]:
    """Of each rule: -1 against, 1 for, 0 abstains. No words, no votes."""
    return [F.expr(f"CASE WHEN _quality.n_words = 0 THEN 0 WHEN {_in_counts(bad)} THEN -1 "
                   f"WHEN {_in_counts(good)} THEN 1 ELSE 0 END").alias(name)
            for name, bad, good in RULES]


def base_failed() -> Column:
    return F.expr("_quality.n_words < 20 OR "
                  "100 * _quality.n_repeat_words > 30 * _quality.n_words")


@dataclass(frozen=True)
class Trust:
    """Share of good documents, and how often each rule's vote is right on good and on bad ones."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log-odds that a vote for, and a vote against, adds."""
        return [(log(g / (1 - b)), log((1 - g) / b)) for g, b in zip(self.on_good, self.on_bad)]

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        return log(self.prior / (1 - self.prior)) + sum(
            plus if v > 0 else minus if v < 0 else 0.0
            for v, (plus, minus) in zip(pattern, self.weights()))


def _bounded(share: float, least: float = 0.02, most: float = 0.98) -> float:
    return min(max(share, least), most)


def estimate(counts: dict[tuple[int, ...], int]) -> Trust:
    """Expectation-maximisation over counts of vote patterns.

    A vote never counts against what it says: a rule no better than chance gets no weight. So a
    document that no rule votes against stays at or above the prior.
    """
    rules = range(len(RULES))
    trust = Trust(PRIOR, (TRUST,) * len(RULES), (TRUST,) * len(RULES))
    for _ in range(ROUNDS):
        good = {p: 1 / (1 + exp(-trust.log_odds(p))) for p in counts}
        total = sum(counts.values())

        def share(rule: int, vote: int, weight: Callable[[tuple[int, ...]], float]) -> float:
            cast = sum(n * weight(p) for p, n in counts.items() if p[rule] != 0)
            right = sum(n * weight(p) for p, n in counts.items() if p[rule] == vote)
            return _bounded((right + SMOOTHING * TRUST) / (cast + SMOOTHING))

        on_good = tuple(share(r, 1, lambda p: good[p]) for r in rules)
        on_bad = tuple(max(share(r, -1, lambda p: 1 - good[p]), 1 - on_good[r]) for r in rules)
        prior = _bounded(sum(n * good[p] for p, n in counts.items()) / total, 0.5) if total else PRIOR
        trust = Trust(prior, on_good, on_bad)
    return trust


def fit(measured_docs: DataFrame) -> Trust:
    """Trust in each rule, from the votes on all documents that pass the base rules."""
    names = [name for name, _, _ in RULES]
    rows = (measured_docs.where(~base_failed()).select(*votes())
            .groupBy(*names).count().collect())  # at most 3 ** len(RULES) rows
    return estimate({tuple(r[n] for n in names): r["count"] for r in rows})


def posterior(trust: Trust) -> Column:
    """Probability that a document is good, given its votes."""
    odds = F.lit(log(trust.prior / (1 - trust.prior)))
    for vote, (plus, minus) in zip(votes(), trust.weights()):
        odds = odds + F.when(vote == 1, plus).when(vote == -1, minus).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def kept(trust: Trust) -> Column:
    return ~base_failed() & (posterior(trust) >= 0.5)


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, probability) for every row of docs.

    Null and empty texts have no words and fail the base rules. Repeated rows count each; a null
    doc_id is kept as null; an empty table gives no rows.
    """
    counts = written(measured(docs.select("doc_id", "text")).select("doc_id", "_quality"), "quality")
    trust = fit(counts)
    return counts.select(
        "doc_id", *[F.col(f"_quality.{name}").alias(name) for name in BASE],
        base_failed().alias("base_failed"), kept(trust).alias("kept"),
        F.round(posterior(trust), 6).alias("probability"))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names.

    Texts are measured once and not shuffled. Null and empty texts fail the base rules and go; repeated
    rows and null ids are judged like any others; an empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("row"), "text")
    counts = written(measured(rows).select("row", "_quality"), "quality")
    return counts.where(kept(fit(counts))).select("row.*")


def oracle() -> str:
    """The same in SQL, for DuckDB: base counts by window rows, EM as a recursive query."""
    names = [name for name, _, _ in RULES]
    plain, end = PLAIN_WORD.replace("'", "''"), LINE_END.replace("'", "''")
    space = r"[\x20\x09-\x0D]"
    vote = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {n}"
                     for n, bad, good in RULES)
    odds = "ln(prior / (1 - prior))" + "".join(
        f" + CASE {n} WHEN 1 THEN ln(g_{n} / (1 - b_{n})) WHEN -1 THEN ln((1 - g_{n}) / b_{n}) ELSE 0 END"
        for n in names)
    start = ", ".join(f"{TRUST}::DOUBLE AS g_{n}, {TRUST}::DOUBLE AS b_{n}" for n in names)

    def clipped(x: str, low: float = 0.02) -> str:
        return f"least(greatest({x}, {low}::DOUBLE), 0.98::DOUBLE)"

    def share(n: str, v: int, q: str) -> str:
        return clipped(f"(coalesce(sum(CASE WHEN {n} = {v} THEN n * {q} END), 0) + {SMOOTHING * TRUST}) / "
                       f"(coalesce(sum(CASE WHEN {n} <> 0 THEN n * {q} END), 0) + {SMOOTHING})")

    step = ", ".join(f"{share(n, 1, 'q')} AS g_{n}, "
                     f"greatest({share(n, -1, '(1 - q)')}, 1 - {share(n, 1, 'q')}) AS b_{n}" for n in names)
    return f"""
    WITH RECURSIVE texts AS (
      SELECT doc_id, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda w: w <> '') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)),
          lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
    windows AS (
      SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS w
      FROM texts, unnest(range(1, len(words) - {WINDOW - 2})) AS t(i)),
    twice AS (
      SELECT doc_id, i FROM windows
      QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
    steps AS (
      SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS s
      FROM twice),
    covered AS (SELECT doc_id, sum(s)::BIGINT AS n_repeat_words FROM steps GROUP BY doc_id),
    counted AS (
      SELECT doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
        len(list_filter(words, lambda w: regexp_matches(w, '{plain}')))::BIGINT AS n_plain,
        len(list_filter(lines, lambda l: regexp_matches(l, '{end}')))::BIGINT AS n_ended
      FROM texts LEFT JOIN covered USING (doc_id)),
    voted AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {vote} FROM counted),
    patterns AS (SELECT {', '.join(names)}, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY ALL),
    em AS (
      SELECT 0 AS round, {PRIOR}::DOUBLE AS prior, {start}
      UNION ALL
      SELECT round + 1, {clipped('sum(n * q) / sum(n)', 0.5)}, {step}
      FROM (SELECT em.round, p.*, 1 / (1 + exp(-({odds}))) AS q FROM em, patterns p WHERE em.round < {ROUNDS})
      GROUP BY round)
    SELECT doc_id, {', '.join(BASE)}, base_failed,
      NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept,
      round(1 / (1 + exp(-({odds}))), 6) AS probability
    FROM voted, em WHERE em.round = {ROUNDS}"""
