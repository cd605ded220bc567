"""Places of phrases and the edges between them: kernels against brute force, and what is shuffled."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions import graphs
from dialoom.operators import cooccurrence as co
from dialoom.operators import terms as tm
from dialoom.operators.centrality import rank_rows
from dialoom.params import KeyphraseParams, RankParams

TERMS = ["red_fox", "fox", "red_red_fox", "sea", "old_sea"]
PLACES = "corpus string, doc_id long, rank int, start int, end int"


def made_places(seed, n, far):
    made = np.random.default_rng(seed)
    return sorted((int(made.integers(1, 6)), int(s), int(s + made.integers(0, 3))) for s in made.integers(0, far, n))


def brute(places, cutoff):
    def missing(a, b):
        return sum(w not in b for w in a)

    found = defaultdict(list)
    for a, _, end in places:
        for b, start, _ in places:
            if a != b and 0 < start - end < cutoff:
                x, y = TERMS[a - 1].split("_"), TERMS[b - 1].split("_")
                found[min(a, b), max(a, b)].append(math.log(cutoff / (start - end + max(missing(x, y), missing(y, x)))))
    return {k: sum(v) / len(v) for k, v in found.items()}


@pytest.mark.parametrize("pairs", [1, 40, 1 << 16])
def test_near_weights_against_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(graphs, "PAIRS", pairs)
    for seed, n in ((1, 0), (2, 1), (3, 90)):
        places = made_places(seed, n, 60)
        rank, start, end = np.array(places, np.int64).reshape(-1, 3).T
        src, dst, w, many = graphs.near_weights(rank, start, end, TERMS, 7)
        assert dict(zip(zip(src.tolist(), dst.tolist()), w)) == pytest.approx(brute(places, 7))


@pytest.mark.parametrize("span", [1, 1 << 17])
def test_edges_of_documents_in_blocks_are_those_of_whole_ones(spark, monkeypatch, span):
    monkeypatch.setattr(co, "SPAN", span)
    params = KeyphraseParams(graph_cutoff=7)
    placed = {d: made_places(d, 80, 90) for d in (1, 2)} | {3: made_places(3, 4, 5)}
    rows = [("c", d, *p) for d, of in placed.items() for p in of] + [(None, 1, 1, 0, 0), (None, 1, 2, 2, 2), ("c", None, 1, 0, 0)]
    keys = [("c", d) for d in (1, 2, 3, 4)] + [(None, 1), ("c", None)]
    top = spark.createDataFrame([(*k, i, t, float(i)) for k in keys for i, t in enumerate(TERMS, 1)],
                                "corpus string, doc_id long, rank int, term string, score double")
    positions, lists = spark.createDataFrame(rows, PLACES), co.top_lists(top)
    edges = co.cooccurrence_edges(positions, lists, params)
    got = defaultdict(dict)
    for r in edges.collect():
        got[r.corpus, r.doc_id][r.src, r.dst] = r.w
    assert set(got) == {("c", d) for d in (1, 2, 3)}
    for d in (1, 2, 3):
        assert got["c", d] == pytest.approx(brute(placed[d], 7))
    packed = co.scored_rows(co.near_rows(positions, lists, params))
    row_wise = co.keyphrase_graphs(co.scored_edges(edges), lists)
    whole = [{(r.corpus, r.doc_id): (r.n, sorted((e.src, e.dst, round(e.w, 9)) for e in r.edges)) for r in g.collect()}
             for g in (co.keyphrase_graphs(packed, lists), row_wise)]
    assert whole[0] == whole[1] and len(whole[0]) == len(keys)


def test_neither_pairs_nor_edges_are_shuffled(spark):
    places = spark.createDataFrame([("c", d, *p) for d in range(4) for p in made_places(d, 30, 60)], PLACES)
    top = spark.createDataFrame([("c", d, i, t, float(i)) for d in range(4) for i, t in enumerate(TERMS, 1)],
                                "corpus string, doc_id long, rank int, term string, score double").checkpoint()
    lists = co.top_lists(top)
    ranked = rank_rows(co.keyphrase_graphs(co.scored_rows(co.near_rows(places, lists)), lists), ["corpus", "doc_id", "top"], "pagerank", RankParams(rounds=3))
    for made in (ranked, co.scored_edges(co.cooccurrence_edges(places, lists))):
        made.count()
        plan = made._jdf.queryExecution().executedPlan().toString()
        exchanged = re.findall(r"Exchange [^\n]*", plan.split("== Initial Plan ==")[-1])
        assert len(exchanged) == 2, exchanged  # the places and the lists


@pytest.mark.parametrize("load", [False, True])
def test_graphs_followed_together(load, monkeypatch):
    made, graphs_of = np.random.default_rng(7), []
    for n in (0, 1, 2, 3, 9, 9, 9, 9, 14, 14):
        edges = {(int(min(a, b)), int(max(a, b))): float(made.integers(1, 4)) for a, b in made.integers(0, max(n, 1), (2 * n, 2)) if a != b}
        graphs_of.append((n, *(np.array(x) for x in ([a for a, _ in edges], [b for _, b in edges], list(edges.values())))))
    graphs_of = [(n, a.astype(int), b.astype(int), w.astype(float)) for n, a, b, w in graphs_of]
    for together in (3, 20, 512):
        monkeypatch.setattr(graphs, "TOGETHER", together)
        found = graphs.path_centralities(*[list(x) for x in zip(*graphs_of)], load)
        assert all(x.tolist() == graphs.path_centrality(*g, load).tolist() for x, g in zip(found, graphs_of))


ODD = ["old", "king_s", "s", "kings", "king", "the", "sea_of", "of", "_", "x_", "_x", "sea", "ox", "fox", "a_s_b", "as_b", "b"]


@pytest.mark.parametrize("stop_words", [True, False])
def test_listed_phrases_are_found_where_they_occur(spark, stop_words):
    made = np.random.default_rng(3)
    params = KeyphraseParams(sizes=(1, 2, 3, 4), remove_stopwords=stop_words)
    texts = [[str(w) for w in made.choice(ODD, 60)] for _ in range(6)] + [["fox"], []]
    tokens = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "corpus string, doc_id long, tokens array<string>")
    occ = tm.occurrences(tokens, params).selectExpr("*", "pos AS start", "CAST(pos + size - 1 AS int) AS end")
    # of terms that several sizes give, one size is listed
    top = occ.groupBy("corpus", "doc_id", "term").agg(F.max("size").alias("size")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("corpus", "doc_id").orderBy("term"))).checkpoint()
    want = occ.join(top, ["corpus", "doc_id", "term", "size"]).select("doc_id", "rank", "term", "start", "end")
    got = co.phrase_positions(tokens, top, params).select("doc_id", "rank", "term", "start", "end")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 600


def test_tokens_that_hold_the_words(spark, capsys):
    made = np.random.default_rng(4)
    texts = [[str(w) for w in made.choice([*ODD, "foxes", "seas", "é"], 50)] for _ in range(5)] + [None, []]
    terms = ["fox", "ing_s", "o", "s_f", "_", "ea_of_", "é", "nowhere", "fox_o"]
    top = spark.createDataFrame([("c", i, t, t.count("_") + 1, r) for i in range(7) for r, t in enumerate(terms, 1)],
                                "corpus string, doc_id long, term string, size int, rank int")

    def found(rows):
        tokens = spark.createDataFrame(rows, "corpus string, doc_id long, tokens array<string>")
        made = co.phrase_positions(tokens, top, KeyphraseParams(position_mode="contains"))
        made.explain()
        return sorted((r.doc_id, r.term, r.start, r.end) for r in made.collect()), "Generate posexplode(tokens" in capsys.readouterr().out

    want = sorted((i, t, at, at + t.count("_")) for i, of in enumerate(texts) for t in terms for at in range(len(of or []) - t.count("_"))
                  if all(w in of[at + j] for j, w in enumerate(t.split("_"))))
    rows = [("c", i, t) for i, t in enumerate(texts)]
    assert found(rows) == (want, False) and len(want) > 100  # a token is not a row
    # rows of one document are its parts, whose hits meet
    assert found([*rows, rows[0]]) == (want, True)
    assert (9, "fox", 0, 0) not in want and found([("c", 1, ["fox"]), ("c", 1, ["x", "ox"])])[0] == found([("c", 1, ["fox", "ox"])])[0]
