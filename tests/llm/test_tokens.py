"""Byte-pair encoding and token counts against the public libraries."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from dialoom.llm import byte_bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, pretoken string, rid int"
TEXTS = [None, "", " ", "Hello  World's  <|endoftext|> <|ENDOFTEXT|>x", "a" * 5000, "ÀÉ ½² 𝐀𝐁 😀 中文字 ΣΑΣİ",
         "x\x1cy\x85z w​", "line\n\n  line\t\r\n", "don't WE'LL 12345", "don't WE'LL 12345"]
ROWS = [(i, t, "p", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (3, "again", "q", 2)]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_round_trip_equals_the_library(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encode_then_decode(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.bytes)) for r in back if r.doc_id is not None) == sorted(
        (i, (t or "").encode()) for i, t, *_ in ROWS if i is not None)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.token_counts(docs, WORDS).count() == 0


@pytest.mark.parametrize("leaf", [1, 2, 7, 32])
def test_tree_equals_merging_in_one_piece(library, leaf):
    codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN, leaf)
    made = random.Random(leaf)
    for alphabet in ("a", "ab", "etaoinshrdlu", "aàéñ中", "=-#!", "the and ing"):
        for _ in range(60):
            text = "".join(made.choice(alphabet) for _ in range(made.randint(1, 700)))
            ids = [i for part in codec.encode(text) for i, in struct.iter_unpack("<I", part)]
            assert ids == library.encode_ordinary(text)


def test_scan_and_queue_agree():
    codec = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    made = random.Random(5)
    for _ in range(200):
        piece = bytes(made.choice(b"aaaabtheing ") for _ in range(made.randint(1, 200)))
        assert codec._merge_scan(piece) == codec._merge_queue(piece)


def test_counts_equal_the_library(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    library = Tokenizer.from_file(WORDS)
    want = []
    for doc_id, text, *_ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 7))
    got = token_counts.token_counts(docs, WORDS, limit=7).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_counts_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, WORDS).collect()}
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids)
            for r in docs.collect()}
    assert got == want
