"""Mixing and quality rules against their SQL and plain counting."""

import math
import re
from collections import Counter
from hashlib import md5

import duckdb
import pytest
from pyspark.sql import functions as F

from dialoom.llm import mixing, quality

SMALL = "/root/testdata/sf0.001"


def sql_rows(statement):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    con.execute(statement)
    names = [d[0] for d in con.description]
    return sorted(map(str, (dict(sorted(zip(names, r))) for r in con.fetchall())))


def spark_rows(frame):
    return sorted(str(dict(sorted(r.asDict().items()))) for r in frame.collect())


def plain_count(rate, draw):
    k, p, upto = 0, math.exp(-rate), math.exp(-rate)
    while upto <= draw:
        k += 1
        p *= rate / k
        upto += p
    return k


def test_mix_equals_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert spark_rows(mixing.mix(docs)) == sql_rows(mixing.oracle())


def test_draws_and_rates(spark):
    rows = [(i, "x" * (10 + i % 7), f"s{i % 3}" if i % 5 else None, i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    weights = spark.createDataFrame([("s0", 3.0), ("s1", 1.0), (None, 1.0), ("absent", 9.0)], "source string, weight double")
    chars = Counter()
    for _, text, source, _ in rows:
        chars[source] += len(text)
    total = sum(chars.values())
    rate = {s: w / 5 * total / chars[s] for s, w in (("s0", 3), ("s1", 1), (None, 1))} | {"s2": 0.0}
    got = {r.source: r.rate for r in mixing.rates(docs, weights).collect()}
    assert got == pytest.approx(rate)
    want = Counter()
    for i, text, source, _ in rows:
        draw = int(md5(f"20:{i}:{len(text)}".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[i] = plain_count(rate[source], draw)
    mixed = mixing.mix(docs, weights).collect()
    assert Counter(r.doc_id for r in mixed) == +want
    assert sorted(mixed[0].asDict()) == ["copy", "doc_id", "place", "source", "text"]


def exact_upto(rate):
    """P(count <= k) from logarithms, for k within 12 deviations of the rate."""
    low, high = (max(0, int(rate + side * 12 * math.sqrt(rate))) for side in (-1, 1))
    upto, total = {}, 0.0
    for k in range(low, high + 1):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        upto[k] = total
    return upto


@pytest.mark.parametrize("rate, n", [(690.0, 1000), (750.0, 2000), (5000.0, 1000), (1_000_000.0, 30)])
def test_large_rates(spark, rate, n):
    docs = spark.createDataFrame([(i, "some text", None) for i in range(n)], "doc_id long, text string, source string")
    rated = spark.createDataFrame([(None, rate)], "source string, rate double")
    counts = sorted(r.copies for r in mixing.counted(docs.repartition(4), rated).collect())
    assert len(counts) == n and len(set(counts)) > n // 20
    upto = exact_upto(rate)
    farthest = max(max(abs((i + 1) / n - upto[c]) if i + 1 == n or counts[i + 1] != c else 0,
                       abs(i / n - upto[c - 1]) if i == 0 or counts[i - 1] != c else 0) for i, c in enumerate(counts))
    assert farthest < 1.95 / math.sqrt(n)
    assert counts[-1] <= mixing.most_copies(rate)


def test_one_short_document_among_large_sources(spark):
    rows = [(i, "x" * 4000, "large") for i in range(50)] + [(99, "x" * 100, "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = Counter(r.doc_id for r in mixing.mix(docs).collect())[99]
    assert abs(copies - 1001) < 6 * math.sqrt(1001)


def test_mix_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "a"), (2, "text", "b"), (2, "text", "b")],
                                 "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.mix(docs).collect()} <= {2}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_leaves_other_columns_alone(spark):
    rows = [(i if i % 2 else None, f"text {i}", "s", i, -i, "own", "x", 0.5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int, _count int, place string, row string, draw double")
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)
    mixed = mixing.mix(docs).collect()
    assert len({r.place for r in mixed}) == len(mixed)  # also of rows without an id


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen, repeated = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), failed)


TEXTS = [None, "", " \n\t", "a b c", "one two three four five six seven eight " * 6, "x" * 5000,
         "é😀 ü\x0b" * 40, "same line here\nsame line here\n\n \nsame line here \n",
         " ".join(f"w{i % 23}" for i in range(200)), " ".join(f"w{i}" for i in range(60)) + "\nAB CD. ### | <x>",
         "a " * 500]


def test_base_counts(spark):
    docs = spark.createDataFrame([(i, t, "k", 3) for i, t in enumerate(TEXTS)] + [(None, None, None, None)],
                                 "doc_id long, text string, kept string, n_words int")
    rows = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (*(r[n] for n in quality.BASE), r.base_failed) == plain_base(text)
        assert not (r.base_failed and r.kept)
    assert quality.quality(docs.limit(0)).count() == 0
    clashing = docs.select("*", *[F.lit("own").alias(c) for c in ("_words", "_lines", "_quality", "row", "symbols")])
    kept = quality.good_documents(clashing)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows.values() if r.kept}
    assert {r["_words"] for r in kept.collect()} == {"own"}
    assert quality.good_documents(clashing.limit(0)).count() == 0


def test_quality_equals_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert spark_rows(quality.quality(docs)) == sql_rows(quality.oracle())


def test_estimate_tells_rules_apart():
    n = len(quality.RULES)
    good, bad = (1,) * n, (-1,) * 3 + (1,) * (n - 3)
    trust = quality.estimate({good: 900, bad: 80, (1,) * (n - 1) + (-1,): 20})
    assert trust.log_odds(good) > 0 > trust.log_odds(bad)
    assert trust.log_odds((0,) * n) > 0  # nobody votes: the prior decides


def test_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) == len(clean)
    assert sum(junk) <= 0.2 * len(junk)
