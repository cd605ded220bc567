"""Removed bytes against a plain reading of the rule."""

import hashlib
import random

from dialoom.llm import suffix_dedup

SCHEMA = "doc_id long, text string, kept string, run int"


def brute(rows):
    owner = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        if doc_id is not None:
            for s in range(len(raw) - 49):
                piece = raw[s:s + 50]
                owner[piece] = min(owner.get(piece, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if doc_id is not None:
            for s in range(len(raw) - 49):
                if owner[raw[s:s + 50]] < doc_id:
                    gone[s:s + 50] = b"\x01" * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r)[:5] for r in suffix_dedup.without_repeats(frame).collect()), key=str)


def test_planted_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 3)
    made = random.Random(6)
    letters = "abcdefg é"

    def text(n):
        return "".join(made.choice(letters) for _ in range(n))

    passages = [text(n) for n in (47, 48, 49, 50, 51, 60, 75, 120, 400)]
    rows = [(0, None), (1, ""), (2, "short"), (None, passages[7]), (3, "a" * 300), (4, "b" + "a" * 200 + "c"),
            (5, "ab" * 200), (6, "ba" * 90 + "x" + "ab" * 60)]
    for i in range(10, 60):
        parts = [text(made.randint(0, 60))]
        for _ in range(made.randint(0, 4)):
            p = made.choice(passages)
            cut = made.randint(0, 10)
            parts += [p[cut:] if made.random() < 0.5 else p, text(made.randint(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(70, rows[-1][1]), (71, rows[-1][1]), (12, rows[-3][1]), (80, rows[20][1]), (80, rows[20][1])]
    made.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)
    assert got(docs) == brute(rows)


def test_piece_borders(spark, monkeypatch):
    """Repeats across the borders of pieces of long texts."""
    made = random.Random(7)
    long = "".join(made.choice("abcdef") for _ in range(3 * suffix_dedup.PIECE // 2))
    shift = "zz" + long[1000:] + long[suffix_dedup.PIECE - 200:suffix_dedup.PIECE + 200]
    rows = [(1, long), (2, shift), (3, long[suffix_dedup.PIECE - 60:suffix_dedup.PIECE + 60])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame) == brute(rows)


def test_documents_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs.limit(0)) == []


def test_runs_cover_every_string_once():
    import numpy as np

    raw = np.frombuffer(("the and of " * 30 + "aaaa" * 40).encode(), np.uint8)
    found = suffix_dedup.runs(raw)
    assert found.lengths().sum() == len(raw) - 49 and found.lengths().max() <= suffix_dedup.WINDOW
    windows = [bytes(raw[i:i + 50]) for i in range(len(raw) - 49)]
    assert len(set(windows)) == len(set(found.strings.tolist()))
