"""Given vectors as sentences, against plain numpy."""

import numpy as np
import pytest

from dialoom.functions import graphs
from dialoom.operators import common
from dialoom.operators import dense as dn
from dialoom.params import RankParams, SummaryParams
from dialoom.plans.summaries import dense_summaries


def frame(spark, groups):
    rows = [("c", d, 10 * i + 3, [float(x) for x in v]) for d, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "corpus string, doc_id long, pos long, v array<double>")


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_numbers_follow_the_order(spark, monkeypatch):
    monkeypatch.setattr(common, "NUMBERED", 5)
    rows = [("a", i * i) for i in range(40)] + [("b", -7 + i) for i in range(12)]
    got = common.numbered(spark.createDataFrame(rows, "k string, o long"), ["k"], "o", "nr").collect()
    for key in "ab":
        assert [r.nr for r in sorted((r for r in got if r.k == key), key=lambda r: r.o)] == list(range(sum(k == key for k, _ in rows)))


@pytest.mark.parametrize("block", [1024, 7])
def test_links_above_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(dn, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    groups = {1: rng.normal(size=(40, 5)), 2: rng.normal(size=(9, 5)), 3: rng.normal(size=(1, 5))}
    rows = common.numbered(frame(spark, groups), ["corpus", "doc_id"], "pos", "node")
    got = {(r.doc_id, r.src, r.dst): round(r.w, 9) for r in dn.similar_dense(rows, 0.3).collect()}
    want = {}
    for d, v in groups.items():
        w = unit(v) @ unit(v).T
        want |= {(d, i, j): round(w[i, j], 9) for i in range(len(v)) for j in range(i + 1, len(v)) if w[i, j] >= 0.3}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("given", [False, True])
def test_summaries_of_given_vectors(spark, given):
    rng = np.random.default_rng(8)
    groups = {d: rng.normal(0.4, 1, size=(n, 6)) for d, n in ((1, 30), (2, 5), (3, 2))}
    whole = {d: rng.normal(0.4, 1, size=6) if given else v.mean(0) for d, v in groups.items()}
    vectors = frame(spark, groups)
    documents = spark.createDataFrame([("c", d, [float(x) for x in v]) for d, v in whole.items()],
                                      "corpus string, doc_id long, v array<double>") if given else None
    p = SummaryParams(min_sentences=2, max_sentences=9)
    sentences = vectors.selectExpr("corpus", "doc_id", "pos", "IF(pos % 20 = 3, 'one two three four five six seven eight', NULL) AS sentence")
    got = dense_summaries(sentences, vectors, documents, p, RankParams(rounds=20)).collect()
    for d, v in groups.items():
        w = unit(v) @ unit(v).T
        i, j = np.nonzero(np.triu(w >= 0.3, 1))
        score = graphs.pagerank(len(v), i, j, w[i, j], RankParams(rounds=20))
        score = score * np.where(np.arange(len(v)) % 2 == 0, np.log(2) + 1, 1.0)  # eight words
        order = sorted(range(len(v)), key=lambda k: (-round(score[k], 9), k))
        loss = {}
        for n in range(2, 10):
            m = v[order[:n]].mean(0)
            sim = m @ whole[d] / np.linalg.norm(m) / np.linalg.norm(whole[d])
            loss[n] = round((1 - sim) ** 2 + p.penalty * n, 9)
        n = min(loss, key=lambda k: (loss[k], k))
        want = [(k, 10 * x + 3, round(score[x], 9)) for k, x in enumerate(sorted(order[:n]), 1)]
        assert sorted((r.ord, r.pos, round(r.score, 9)) for r in got if r.doc_id == d) == want


def test_odd_vectors(spark):
    rows = [("c", 1, 0, [1.0, 0.0]), ("c", 1, 1, None), ("c", 1, 2, [0.0, 0.0]), ("c", 1, 3, [float("nan"), 1.0]),
            ("c", 1, 4, [2.0, 0.1]), ("c", 2, 0, None)]
    vectors = spark.createDataFrame(rows, "corpus string, doc_id long, pos long, v array<double>")
    sentences = vectors.selectExpr("corpus", "doc_id", "pos", "CAST(NULL AS STRING) AS sentence")
    got = dense_summaries(sentences, vectors, params=SummaryParams(min_sentences=1, max_sentences=3)).collect()
    assert {r.doc_id for r in got} == {1, 2}
    assert {0, 4} & {r.pos for r in got if r.doc_id == 1}
    assert dense_summaries(sentences.limit(0), vectors.limit(0)).count() == 0
