import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.functions import graphs
from dialoom.functions.nearest import Block
from dialoom.operators import cooccurrence as co
from dialoom.operators import common, sentences as st
from dialoom.operators import similar as sm
from dialoom.operators import terms as tm
from dialoom.operators.centrality import centrality, pagerank_by_rounds
from dialoom.params import KeyphraseParams, RankParams
from dialoom.plans.keyphrases import keyphrases, segment_keyphrases
from dialoom.session import bucketed, cut_lineage


def arrays(edges):
    a = np.array(edges, dtype=float).reshape(-1, 3)
    return a[:, 0].astype(int), a[:, 1].astype(int), a[:, 2]


def test_pagerank_path_and_lone_node():
    rank = graphs.pagerank(4, *arrays([(0, 1, 1), (1, 2, 1)]), RankParams(tolerance=1e-12))
    assert rank == pytest.approx([0.244530, 0.463320, 0.244530, 0.047619], abs=1e-5)
    assert rank.sum() == pytest.approx(1)


def brute_betweenness(n, edges):
    """Enumerate all simple paths of a small graph."""
    w = {}
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    total = np.zeros(n)
    for s, t in itertools.permutations(range(n), 2):
        best, found = np.inf, []
        for r in range(n - 1):
            for mid in itertools.permutations([v for v in range(n) if v not in (s, t)], r):
                path = (s, *mid, t)
                if all(p in w for p in zip(path, path[1:])):
                    length = sum(w[p] for p in zip(path, path[1:]))
                    if length < best:
                        best, found = length, []
                    if length == best:
                        found.append(mid)
        for mid in found:
            for v in mid:
                total[v] += 1 / len(found)
    return total / ((n - 1) * (n - 2))


@pytest.mark.parametrize("edges", [
    [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1)],
    [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 1)],
    [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)],
    [(0, 1, 2), (1, 3, 2), (0, 2, 1), (2, 3, 3), (3, 4, 1)],
])
def test_betweenness_against_brute_force(edges):
    n = max(max(a, b) for a, b, _ in edges) + 1
    assert graphs.path_centrality(n, *arrays(edges), load=False) == pytest.approx(brute_betweenness(n, edges))


def test_load_of_star_and_square():
    star = graphs.path_centrality(5, *arrays([(0, i, 1) for i in range(1, 5)]), load=True)
    assert star == pytest.approx([1, 0, 0, 0, 0])
    square = graphs.path_centrality(4, *arrays([(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 1)]), load=True)
    assert square == pytest.approx([1 / 6] * 4)


def test_large_graphs_take_rounds_with_the_same_ranks(spark):
    edges = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, 2, 2.0), ("b", 0, 1, 3.0)],
                                  "g string, src int, dst int, w double")
    sizes = spark.createDataFrame([("a", 4), ("b", 2), ("c", 1)], "g string, n int")
    p = RankParams(tolerance=0.02)

    def ranks(df):
        return {(r.g, r.node): r["rank"] for r in df.collect()}

    small = ranks(centrality(sizes, edges, ["g"], p=p))
    assert ranks(pagerank_by_rounds(sizes, edges, ["g"], p)) == pytest.approx(small)
    assert ranks(centrality(sizes, edges, ["g"], p=RankParams(tolerance=0.02, max_group_edges=1))) == pytest.approx(small)


def test_edge_weight(spark):
    pos = spark.createDataFrame([("c", 1, 1, "iron_throne", 3, 4), ("c", 1, 2, "king", 10, 10)],
                                "corpus string, doc_id long, rank int, term string, start int, end int")
    top = spark.createDataFrame([("c", 1, 1, "iron_throne", 1.0), ("c", 1, 2, "king", 1.0)],
                                "corpus string, doc_id long, rank int, term string, score double")
    rows = co.cooccurrence_edges(pos, co.top_lists(top)).collect()
    assert [(r.src, r.dst, round(r.w, 6)) for r in rows] == [(1, 2, 4.135167)]


def test_pruning_keeps_the_top_list(spark):
    texts = ["red fox jumps over the lazy dog while red fox sleeps", "blue fox runs far from the lazy dog",
             "green birds sing for the red fox every lovely morning"]
    docs = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "corpus string, doc_id long, text string")
    p = KeyphraseParams(take_top=3)
    want = tm.top_terms(tm.scored_terms(docs, p), p)
    got = tm.keyphrase_candidates(docs, p)
    cols = ["doc_id", "rank", "term"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_factors(spark):
    row = spark.range(1).select(
        tm.first_position_factor(F.lit(1)).alias("a"), tm.first_position_factor(F.lit(100)).alias("b"),
        tm.length_factor(F.lit(2)).alias("c"), tm.title_factor(F.lit(2), F.lit(3)).alias("d"),
        tm.title_factor(F.lit(1), F.lit(3)).alias("e")).first()
    assert [round(v, 6) for v in row] == [8.612503, 6.309918, 1.098612, 1.231049, 1.0]


@pytest.mark.parametrize("block,pivots", [(1024, 64), (16, 4)])
def test_dense_neighbours_against_brute_force(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(sm, "BLOCK_ROWS", block)
    monkeypatch.setattr(sm, "PIVOTS", pivots)
    rng = np.random.default_rng(1)
    v = np.vstack([rng.normal(c, 0.3, (25, 4)) for c in (-2, 0.5, 2)])
    v[50:60] = v[3]
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in sm.similar_vectors(rows, 5).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    for i in range(len(v)):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-sims[i, j], j))[:5]
        assert [o for _, o in sorted(got[i])] == order


def test_dense_vectors_are_copied_per_block_not_per_cell(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK_ROWS", 100)
    sent, measure = [], sm._measure
    monkeypatch.setattr(sm, "_measure", lambda asking, data, k: sent.append(asking.count()) or measure(asking, data, k))
    v = np.random.default_rng(2).normal(size=(300, 48))  # angles exclude nothing here
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    assert sm.similar_vectors(rows, 5).count() == 1500
    assert sum(sent) <= 300 * 3


@pytest.mark.parametrize("load", [False, True])
def test_lists_equal_the_matrix(load, monkeypatch):
    made = np.random.default_rng(4)
    for n in (3, 9, 40):
        edges = {(min(a, b), max(a, b)): float(made.integers(1, 4)) for a, b in made.integers(0, n, (3 * n, 2)) if a != b}
        graph = arrays([(a, b, w) for (a, b), w in edges.items()])
        matrix = graphs.path_centrality(n, *graph, load=load)
        parts = sum(graphs.path_centrality(n, *graph, load=load, first=i, count=7) for i in range(0, n, 7))
        monkeypatch.setattr(graphs, "MATRIX_NODES", 0)
        assert graphs.path_centrality(n, *graph, load=load) == pytest.approx(matrix)
        monkeypatch.undo()
        assert parts == pytest.approx(matrix)


@pytest.mark.parametrize("measure", ["betweenness centrality", "load centrality"])
def test_large_graphs_are_ranked_alike(spark, measure):
    made = np.random.default_rng(5)
    rows = {(int(min(a, b)), int(max(a, b))): float(made.integers(1, 4)) for a, b in made.integers(0, 150, (500, 2)) if a != b}
    edges = spark.createDataFrame([("g", a, b, w) for (a, b), w in rows.items()], "g string, src int, dst int, w double")
    sizes = spark.createDataFrame([("g", 150), ("h", 2)], "g string, n int")

    def ranks(p):
        return {(r.g, r.node): r["rank"] for r in centrality(sizes, edges, ["g"], measure, p).collect()}

    whole = ranks(RankParams())
    assert ranks(RankParams(max_group_edges=1)) == pytest.approx(whole)
    assert ranks(RankParams(max_group_nodes=100)) == pytest.approx(whole)


@pytest.mark.parametrize("floor", [0.0, 0.2])
def test_nearest_of_a_block(floor):
    rng = np.random.default_rng(5)
    n, size, k = 60, 40, 4
    whole = rng.random((n, size)) * (rng.random((n, size)) < 0.2)
    whole[10:14] = whole[9]
    whole[20] = 0
    terms = [np.flatnonzero(row) * 3 for row in whole]
    block = Block(np.arange(n)[::-1] * 7, [t for t in terms[::-1]], [row[row > 0] for row in whole[::-1]])
    sims = np.round(whole @ whole.T, 9)
    for i in range(n):
        ids, found, touched = block.nearest(i * 7, terms[i], whole[i][whole[i] > 0], k, floor)
        want = sorted((j for j in range(n) if j != i and sims[i, j] > 0), key=lambda j: (-sims[i, j], j))[:k]
        assert [7 * j for j in want if sims[i, j] >= floor] == ids.tolist()
        assert np.round(found, 9) == pytest.approx([sims[i, j] for j in want if sims[i, j] >= floor])
        assert touched <= n - 1
    assert block.nearest(1, np.array([1, 200]), np.array([1.0, 2.0]), k)[0].size == 0


def test_documents_in_several_blocks(spark, monkeypatch):
    """Small blocks and one block give the same lists, with ties, copies and documents that share nothing."""
    made = np.random.default_rng(2)
    texts = [" ".join(made.choice([f"word{chr(97 + i)}{chr(97 + i % 7)}" for i in range(40)], made.integers(1, 12))) for _ in range(60)]
    docs = spark.createDataFrame([("c" if i % 3 else "d", i, t) for i, t in enumerate([*texts, texts[4], "unique", None, ""])],
                                 "corpus string, doc_id long, text string")
    found = []
    for size in (1024, 7):
        monkeypatch.setattr(sm, "BLOCK_DOCS", size)
        found.append(sorted((r.corpus, r.doc_id, r["rank"], r.other, round(r.sim, 9)) for r in sm.similar_documents(docs, 5).collect()))
    assert found[0] == found[1] and len(found[0]) == 5 * 64


def test_blocks_hold_leads_only_and_pairs_of_blocks_meet_once(spark, monkeypatch):
    made = np.random.default_rng(3)
    texts = [" ".join(made.choice(["stone", "king", "crown", "river", "winter", "dragon"], 5)) for _ in range(9)]
    docs = spark.createDataFrame([("c", i, texts[i % 9]) for i in range(36)], "corpus string, doc_id long, text string")
    words = sm.content_words(docs).localCheckpoint()
    leads = sm.copies(words).where("doc_id = lead").select("corpus", "doc_id").localCheckpoint()
    monkeypatch.setattr(sm, "BLOCK_DOCS", 3)
    packed = sm.packed_vectors(words, leads).localCheckpoint()
    n = leads.count()
    assert packed.count() == n
    assert packed.agg(F.max("block")).first()[0] == (n - 1) // 3  # copies take no place in a block
    weights = {(r.doc_id): sorted(round(w, 9) for w in r.weights) for r in packed.collect()}
    assert weights == {r.doc_id: sorted(round(w, 9) for w in r.weights) for r in sm.packed_vectors(words).collect() if r.doc_id in weights}
    plan = sm.nearest_leads(packed, 2)
    pairs = plan._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count("explode(") == 1 and "CoGroup" not in pairs  # a document is copied on one side only
    whole = {}
    for size in (3, 100):
        monkeypatch.setattr(sm, "BLOCK_DOCS", size)
        whole[size] = sorted((r.x, r.y, round(r.sim, 9)) for r in sm.nearest_leads(sm.packed_vectors(words, leads).localCheckpoint(), 2).collect())
    assert whole[3] == whole[100]


def test_links_in_buckets_are_not_shuffled(spark):
    links = spark.createDataFrame([("c", 1, 0, 1, 0.5), ("c", 1, 1, 0, 0.5)], "corpus string, doc_id long, node int, to int, w double")
    table = bucketed(links, "links", "corpus", "doc_id", "node")
    ranks = cut_lineage(links.select("corpus", "doc_id", "node", F.lit(0.5).alias("rank")))
    met = spark.table(table).join(ranks.hint("shuffle_hash"), ["corpus", "doc_id", "node"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan  # that of the ranks
    assert met.count() == 2
    spark.sql(f"DROP TABLE {table}")


@pytest.mark.parametrize("mode", ["exact", "contains"])
def test_segments_count_as_whole_documents(spark, mode):
    made = np.random.default_rng(11)
    words = ["red", "fox", "river", "king", "landing", "of", "the", "winter", "foxes"]
    segments = [("c", d, i, " ".join(made.choice(words, made.integers(0, 4)))) for d in range(4) for i in range(30)]
    whole = [("c", d, " ".join(t for _, e, _, t in segments if e == d)) for d in range(4)]
    params = KeyphraseParams(sizes=(1, 2, 3, 5), take_top=12, graph_cutoff=9, position_mode=mode)
    parts = spark.createDataFrame(segments, "corpus string, doc_id long, segment long, text string")
    docs = spark.createDataFrame(whole, "corpus string, doc_id long, text string")
    tokens = [tm.tokenized(docs, params), tm.segment_tokens(parts, params)]
    tops = [tm.keyphrase_candidates(docs, params, tokens=t) for t in tokens]
    places = [co.phrase_positions(t, tops[0], params) for t in tokens]
    ranks = [keyphrases(docs, params, RankParams(rounds=9)), segment_keyphrases(parts, params, RankParams(rounds=9))]
    for a, b, cols in ((*tops, ("doc_id", "rank", "term", "first_pos")), (*places, ("doc_id", "rank", "start", "end")),
                       (*ranks, ("doc_id", "rank", "term"))):
        rows = sorted(map(tuple, a.select(*cols).collect()))
        assert rows and rows == sorted(map(tuple, b.select(*cols).collect()))
    assert segment_keyphrases(parts.limit(0), params).count() == 0


def test_tasks_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_TEXT", 100)
    docs = spark.createDataFrame([("c", i, "red fish and blue fish swim " * 5) for i in range(30)], "corpus string, doc_id long, text string")
    assert tm.tokenized(docs).rdd.getNumPartitions() == 42
    assert st.distinct_sentences(docs).rdd.getNumPartitions() == 42


def test_occurrences_are_not_shuffled(spark, capsys):
    docs = spark.createDataFrame([("c", i, "red fish and blue fish swim in the red sea") for i in range(3)], "corpus string, doc_id long, text string")
    tokens, top = tm.tokenized(docs), tm.keyphrase_candidates(docs).checkpoint()
    for mode in ("exact", "contains"):
        co.phrase_positions(tokens, top, KeyphraseParams(position_mode=mode)).explain()
    plans = re.findall(r"hashpartitioning\([^)]*", capsys.readouterr().out)
    assert plans and not any("term" in p or "token" in p for p in plans)


def test_sentence_vectors_are_shuffled_once(spark, capsys, monkeypatch):
    monkeypatch.setattr(st, "BLOCK_SENTENCES", 2)
    docs = spark.createDataFrame([("c", i, "A red fish swims. The red fish eats. Blue fish swim. One red fish swims. Sea.") for i in range(3)],
                                 "corpus string, doc_id long, text string")
    vectors = st.unit_vectors(st.sentence_weights(st.distinct_sentences(docs))).checkpoint()
    found = st.similar_sentences(vectors, 0.3)
    found.explain()
    assert "src" not in "".join(re.findall(r"hashpartitioning\([^)]*", capsys.readouterr().out))
    rows = {}
    for r in vectors.collect():
        rows.setdefault((r.doc_id, r.pos), {})[r.term] = r.u
    want = {(d, i, j) for d, i in rows for e, j in rows if d == e and i < j
            and round(sum(u * rows[d, j].get(t, 0.0) for t, u in rows[d, i].items()), 9) >= 0.3}
    assert {(r.doc_id, r.src, r.dst) for r in found.collect()} == want and want


@pytest.mark.parametrize("take", [1, 3, 50])
def test_contenders_without_a_window_over_all_terms(spark, capsys, take):
    docs = spark.createDataFrame([("c", i, "red fish and blue fish swim in the deep red sea near old harbour walls " * (i + 1)) for i in range(3)],
                                 "corpus string, doc_id long, text string")
    p = KeyphraseParams(take_top=take)
    terms = tm.join_dimension(tm.document_terms(tm.tokenized(docs, p), p), tm.corpus_sizes(docs), ["corpus"]).checkpoint()
    few = tm.contenders_of_few(terms, p)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, tm.contenders(terms, p).select(few.columns).collect()))
    few.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
