"""The stages of the pipeline against plain readings of what each has to do."""

import base64

import public_tokenizers
import tiktoken

import corpus_pipeline
from dialoom.llm import secret_scan

from .test_mixing_quality import plain_base
from .test_near_dedup import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    results = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        results.append(rows)
    start, good, one, clean, mixed, tokens = results
    assert all(not plain_base(r.text)[-1] for r in good) and {r.doc_id for r in good} <= {r.doc_id for r in start}
    assert {r.doc_id for r in one} == {d for d, _, _, kept in brute(
        [(r.doc_id, r.text) for r in good], corpus_pipeline.NEAR_PERCENT) if kept}
    texts = {r.doc_id: r.text for r in one}
    assert {r.doc_id for r in clean} == set(texts)
    for r in clean:
        if not secret_scan.base_spans(texts[r.doc_id]):
            continue
        assert secret_scan.MASK in r.text and not any(
            s in r.text for s in secret_scan.secret_strings(texts[r.doc_id])) and r.n_chars == len(r.text)
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in clean}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, len(library.encode_ordinary(r.text))) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens) for r in tokens) == want


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "secret_scan", "mixing", "byte_bpe"]


def test_odd_rows_through_all_stages(spark):
    prose = "This is a sentence of plain words that reads like any other sentence in prose. " 
    texts = [None, "", " \n", "word", prose * 3, prose * 3, " ".join(f"word{i}" for i in range(400)) + ".",
             "\n".join(f"Line number {w} says something quite new about {w}." for w in "abcdefghijklmnop"), "x" * 40_000]
    names = ("_words", "_lines", "_quality", "_rid", "rid", "row", "_source", "_count", "_place", "copy", "place", "_staying", "n_tokens")
    rows = [(i // 2 if i % 3 else None, t, "en", f"s{i % 2}" if i % 4 else None, len(t or ""), *[f"{n} {i}" for n in names])
            for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, ", ".join(
        ["doc_id long, text string, lang string, source string, n_chars long", *[f"{n} string" for n in names]]))
    for start in (docs, docs.limit(0)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, at, SMALL)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == docs.columns, name
            found = [tuple(r) for r in made.collect()]
            assert bool(found) == (start is docs), name
            if name in ("quality_rules", "near_dedup", "mixing"):
                assert set(found) <= {tuple(r) for r in at.collect()}, name
            at = spark.createDataFrame(found, made.schema)
