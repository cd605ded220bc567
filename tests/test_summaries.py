"""Summaries: what is shuffled, and the similarity of leading sentences against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.operators import common
from dialoom.operators import sentences as st
from dialoom.operators.centrality import centrality
from dialoom.params import RankParams, SummaryParams
from dialoom.plans import summaries as sm

WORDS = ["red", "fox", "river", "king", "landing", "of", "the", "winter", "sea", "stone"]


def made_docs(spark, n=6):
    made = np.random.default_rng(5)
    texts = [". ".join(" ".join(made.choice(WORDS, made.integers(1, 9))) for _ in range(made.integers(1, 30))) for _ in range(n)]
    rows = [("c", i, t) for i, t in enumerate(texts)] + [("c", 90, ""), ("c", 91, None), (None, 7, texts[0]), ("c", None, texts[1])]
    return spark.createDataFrame(rows, "corpus string, doc_id long, text string")


def exchanges(df):
    df.count()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"Exchange hashpartitioning[^\n]*", plan)


def test_leading_sentences_against_brute_force(spark):
    p = SummaryParams(min_sentences=2, max_sentences=6)
    sentences, vectors = sm._sentences(made_docs(spark))
    ranked = sm._ranks(sentences, vectors, p, RankParams(rounds=5)).checkpoint()
    unit, whole, leads = {}, {}, {}
    for r in vectors.collect():
        unit.setdefault((r.corpus, r.doc_id, r.pos), {})[r.term] = r.u
        of = whole.setdefault((r.corpus, r.doc_id), {})
        of[r.term] = of.get(r.term, 0) + r.w
    for r in ranked.collect():
        leads.setdefault((r.corpus, r.doc_id), {})[r["rank"]] = r.pos
    got = {(r.corpus, r.doc_id, r.n): r.similarity for r in st.candidate_similarity(vectors, ranked, p).collect()}
    assert set(got) == {(*d, n) for d in leads for n in range(2, 7)} and len(leads) == 6
    for (*d, n), similarity in got.items():
        total, of = {}, whole.get(tuple(d), {})
        for rank, pos in leads[tuple(d)].items():
            for t, u in unit.get((*d, pos), {}).items() if rank <= n else ():
                total[t] = total.get(t, 0) + u
        lengths = [sum(x * x for x in v.values()) ** 0.5 for v in (total, of)]
        want = sum(x * of[t] for t, x in total.items()) / (lengths[0] * lengths[1]) if all(lengths) else 0
        assert similarity == pytest.approx(want)


def test_sentences_and_vectors_are_not_shuffled_again(spark, monkeypatch, request):
    monkeypatch.setattr(common, "TASK_TEXT", 200)
    monkeypatch.setattr(sm, "TASK_TEXT", 200)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast))
    sentences, vectors = sm._sentences(made_docs(spark, 12))
    assert not exchanges(st.similar_sentences(vectors, 0.3, lie_together=True))
    edges = st.similar_sentences(vectors, 0.3, lie_together=True).checkpoint()
    ranks = centrality(st.graph_sizes(sentences), edges, st.DOC, p=RankParams(rounds=3)).checkpoint()
    ranked = st.ranked_sentences(sentences, ranks, SummaryParams())
    assert len(exchanges(ranked)) == 2  # the ranks, to be listed and to meet the sentences
    found = st.candidate_similarity(vectors, sm.together(ranked, "ranked", common.text_parts(made_docs(spark, 12), 200), *st.DOC), SummaryParams())
    assert not exchanges(found)
    # as many tasks as the text asks for, and what is read by document without them is the same
    assert sentences.groupBy(*st.DOC).agg(F.count("*")).count() == 14
    spread = st.similar_sentences(vectors.checkpoint(), 0.3)
    rows = [sorted((r.doc_id, r.src, r.dst, round(r.w, 9)) for r in x.collect()) for x in (spread, edges)]
    assert rows[0] == rows[1] and len(rows[0]) > 20


def test_sentences_are_made_once_while_their_documents_are_in_use(spark):
    docs = made_docs(spark)
    assert sm._sentences(docs)[1] is sm._sentences(docs)[1] is not sm._sentences(made_docs(spark))[1]


def test_pagerank_of_many_nodes_takes_the_kernel(spark, monkeypatch):
    monkeypatch.setattr("dialoom.operators.centrality.pagerank_by_rounds", None)
    sizes = spark.createDataFrame([("g", 3000)], "g string, n int")
    edges = spark.createDataFrame([("g", i, i + 1, 1.0) for i in range(20)], "g string, src int, dst int, w double")
    ranks = centrality(sizes, edges, ["g"], p=RankParams(rounds=3))
    assert ranks.count() == 3000 and ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)
