"""Spelling variants against plain readings."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from dialoom.llm import spelling

SMALL = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_near(words):
    """Near words by way of what deletions leave; distance() is held against it below."""
    near, by_rest = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1:]
            by_rest[i, rest].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in by_rest.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_variants(rows):
    words = plain_words(rows)
    near, forms = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return sorted(((w, forms[w], root(w), n, len(near[w]), forms[w] and words[forms[w]]) for w, n in words.items()), key=str)


def found(docs):
    return sorted(map(tuple, spelling.variants(docs).collect()), key=str)


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_scan_of_a_sorted_list(letters):
    made = random.Random(len(letters))

    def word():
        return "".join(made.choice(letters) for _ in range(made.randint(0, 7)))

    for _ in range(150):
        words = sorted({word() for _ in range(50)})
        sought = made.choice([word(), made.choice(words)])
        assert list(spelling.near_in_list(sought, words)) == [
            i for i, w in enumerate(words) if distance(sought, w) == 1]


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert found(docs) == want and any(r[1] for r in want)


def test_lists_cut_again_lose_no_pair_and_give_none_twice(spark):
    made = random.Random(3)
    words = {"".join(made.choice("abé") for _ in range(made.choice([6, 6, 7, 8, 9, 17]))) for _ in range(900)}
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    cut = spelling.lists(frame, block=8)
    rows = [(r.word, r.near) for r in spelling.near_pairs(cut).collect()]
    near = plain_near(words)
    assert len(rows) == len(set(rows)) and set(rows) == {(w, x) for w in near for x in near[w]}
    assert cut.where("m - a - b >= 2").groupBy(*spelling.KEY).count().where("count > 8").isEmpty()


def test_paths_of_forms(spark):
    texts = [("settle", 5), ("settlee", 25), ("settleed", 125), ("settleedx", 625), ("tsettle", 5)]
    docs = spark.createDataFrame([(1, " ".join([w] * n)) for w, n in texts], "doc_id long, text string")
    want = plain_variants([tuple(r) for r in docs.collect()])
    assert found(docs) == want
    assert {r[0]: r[2] for r in want}["settle"] == "settleedx"


def test_odd_rows(spark):
    rows = [(1, None, 1, "x"), (2, "", 2, "x"), (None, "Übermut übermut ÜBERMUT Übermüt×÷ " * 6, 3, "y"), (3, "wonder " * 9, 1, "x"),
            (3, "wonder " * 9, 1, "x"), (4, "wander," * 5 + "abc " * 20, None, None), (5, "z" * 30_000 + " " + "wonderx." * 5, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, word string")
    want = plain_variants([r[:2] for r in rows])
    assert found(docs) == want and {r[0] for r in want} >= {"wonder", "wander", "wonderx"}
    assert found(docs.limit(0)) == [] and found(docs.limit(2)) == []
