"""Terms: what is shuffled, sorted and shared, by the plans, and the same results."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.queries import queries
from dialoom.functions import text as tx
from dialoom.functions import wordlists as wl
from dialoom.operators import terms as tm
from dialoom.params import KeyphraseParams
from dialoom.session import cut_lineage

DOCS = [("c", 1, "the old king of old stone went home, the old king", "season 1 episode 2 Old King"), ("c", 2, "king of old stone", "Stone"),
        ("d", 1, "a king's stone and 12 old kings", "x"), ("d", 1, "old king again", "x"), ("d", None, "old king", None), (None, 3, None, "y")]
SCHEMA = "corpus string, doc_id long, text string, title string"


def plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())


def test_rules_apply_only_where_one_of_them_fits(spark):
    assert not re.search(tx._SPACED_HINT, " i all so t ") and all(re.search(tx._SPACED_HINT, p) for p, _ in wl.spaced_rules())
    texts = ["we shan tell", " i all so t ", "so he d ve gone", "em", " em ", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tx.expand_contractions(F.col("text")).alias("t"))
    for row in got.collect():
        want = texts[row.i]
        for pattern, full in [*wl.spaced_rules(), *wl.apostrophe_rules()] if want else ():
            want = want.replace(pattern, full)
        assert row.t == want


def test_numbers_among_words(spark):
    texts = {"12 monkeys": ["twelve", "monkeys"], "monkeys 12": ["monkeys", "twelve"], "x12 1x": ["x12", "1x"], "7": ["seven"], "": []}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.w for r in df.select("text", tx.tokenize(F.col("text")).alias("w")).collect()} == texts


def test_subsumption_sorts_nothing(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA).drop("title")
    terms = tm.term_table(tm.occurrences(tm.tokenized(docs)))
    corrected = tm.subsumption_corrected(terms)
    assert "SortAggregate" not in corrected._jdf.queryExecution().executedPlan().toString()
    rows = [r.asDict() for r in terms.collect()]
    want = {(r["corpus"], r["doc_id"], r["term"], r["n"], r["size"], r["first_pos"], r["tf"] - (r["n"] == 1) * sum(
        x["tf"] * x["term"].split("_").count(r["term"]) for x in rows
        if x["n"] > 1 and (x["corpus"], x["doc_id"]) == (r["corpus"], r["doc_id"]))) for r in rows}
    got = [tuple(r[c] for c in ("corpus", "doc_id", "term", "n", "size", "first_pos", "tf")) for r in corrected.collect()]
    assert len(got) == len(rows) and set(got) == want


def test_long_terms_do_not_meet_frequencies(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA).drop("title")
    tokens = tm.tokenized(docs)
    terms, df, sizes = tm.document_terms(tokens), tm.document_frequency(tokens), tm.corpus_sizes(docs)
    idf = tm.idf_table(terms, df, sizes)
    weighted = tm.with_tfidf(terms, df, sizes)
    assert all("Union" in plan(x) and "Union" not in plan(tm.with_tfidf(terms, df, sizes, apart=False)) for x in (idf, weighted))
    assert sorted(map(str, weighted.collect())) == sorted(map(str, tm.with_tfidf(terms, df, sizes, apart=False).collect()))
    got = {(r.corpus, r.term): round(r.idf, 9) for r in idf.collect()}
    assert {(r.corpus, r.term): round(r.tfidf / r.tf, 9) for r in weighted.collect()} == got
    assert any(t.count("_") == 2 for _, t in got)


def test_branches_without_titles_share_the_tokens(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    tokens = tm.tokenized(docs, KeyphraseParams(include_title=True))
    whole, bare = (re.split("RepartitionByExpression", plan(x), maxsplit=1)[1] for x in (tokens, tm.bare(tokens)))
    assert re.sub(r"\s|[:+|-]", "", whole) == re.sub(r"\s|[:+|-]", "", bare)
    labels = {r.doc_id: (r.title_len, sorted(r.title_terms)) for r in tokens.where("corpus = 'c'").collect()}
    assert labels == {1: (6, sorted(tm_labels("season 1 episode 2 old king".split()))), 2: (1, ["stone"])}


def tm_labels(words):
    return {"_".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def test_sizes_of_corpora_are_known_to_the_planner(spark):
    """A row per corpus counts as small even where its documents come from a join of unknown size."""
    docs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "corpus string, doc_id long, text string")
    unknown = cut_lineage(docs)
    joined = cut_lineage(unknown.join(cut_lineage(unknown.select("corpus", "doc_id")), ["corpus", "doc_id"]))
    sizes = tm.corpus_sizes(joined)
    assert {tuple(r) for r in sizes.collect()} == {("a", 2), ("b", 1)}
    assert int(str(sizes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10_000_000


def test_distinct_terms_travel_in_lists(spark, tmp_path, monkeypatch):
    """No row per term is shuffled, whatever a task holds at once; the parts that terms meet in follow the text."""
    made = [*DOCS, ("c", 4, "old king of old stone", "x"), ("c", 5, "", "x"), (None, 6, "old king", "x")]
    spark.createDataFrame(made, SCHEMA).select(F.col("corpus").alias("source"), "doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumnRenamed("source", "corpus")
    terms = tm.term_table(tm.occurrences(tm.tokenized(docs)))
    want = sorted(map(str, terms.select("corpus", "term", "n").distinct().collect()))
    assert "None" in want[-1] and "kings_stone" in str(want) and len(want) < terms.count()

    def by_term(df):
        return re.search(r"Exchange hashpartitioning\([^)]*term", df._jdf.queryExecution().executedPlan().toString())

    queried = queries()["term_length"](spark, str(tmp_path))
    assert by_term(terms.select("corpus", "term", "n").distinct()) and not by_term(queried)
    assert sorted(map(str, queried.select("corpus", "term", F.col("n").cast("int")).collect())) == want
    for held, text in ((tm.HELD, tm.MET_TEXT), (1, 5)):
        monkeypatch.setattr(tm, "HELD", held)
        monkeypatch.setattr(tm, "MET_TEXT", text)
        got = tm.distinct_terms(terms, docs)
        assert sorted(map(str, got.collect())) == want and not by_term(got)
        assert (got.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))) == (text == 5)


@pytest.mark.parametrize("params", [dict(take_top=2), dict(take_top=50), dict(take_top=2, include_title=True), dict(sizes=(2, 5), take_top=3, drop_after_cutoff=True, position_cutoff=7),
                                    dict(take_top=2, remove_stopwords=False, term_len_decay=False)], ids=str)
def test_leading_terms_lack_only_what_cannot_be_listed(spark, params):
    """Counted by a kernel, all terms but those no contender has; documents with folded, odd or repeated rows too."""
    made, words = np.random.default_rng(8), ["old", "king", "kings", "s", "sea", "of", "the", "stone", "a_s_b", "x", "river", "é"]
    texts = [" ".join(made.choice(words[:3] + words[4:8] + words[10:] if i % 2 else words, 40)) for i in range(6)]
    rows = [*DOCS, *[("c", 10 + i, t, " ".join(t.split()[3:7])) for i, t in enumerate(texts)], ("c", 11, texts[2], "stone"), (None, 11, texts[1], "x")]
    p = KeyphraseParams(**params)
    docs = spark.createDataFrame(rows, SCHEMA)
    tokens, sizes = tm.tokenized(docs, p), tm.corpus_sizes(docs)
    terms = tm.join_dimension(tm.document_terms(tokens, p), sizes, ["corpus"])
    got = tm.leading_terms(tokens, sizes, p)

    def rows_of(df):
        return {tuple(map(str, r)) for r in df.select(*sorted(terms.columns)).collect()}

    assert sorted(got.columns) == sorted(terms.columns)
    assert rows_of(tm.contenders(terms, p)) <= rows_of(got) <= rows_of(terms) and got.count() == len(rows_of(got))
    if p.take_top == 50:
        assert rows_of(got) == rows_of(terms)
    weighted = tm.with_tfidf(tm.join_dimension(tm.document_terms(tokens, p), sizes, ["corpus"]), tm.document_frequency(tokens, p), None, apart=False)
    want = tm.top_terms(tm.with_score(weighted, p), p).select("corpus", "doc_id", "rank", "term", F.round("score", 9))
    listed = tm.keyphrase_candidates(docs, p).select("corpus", "doc_id", "rank", "term", F.round("score", 9))
    assert sorted(map(str, listed.collect())) == sorted(map(str, want.collect()))


def test_terms_of_documents_are_not_sorted_for_their_bound(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA).drop("title")
    made = tm.keyphrase_candidates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("Window ") == 1  # the ranks
