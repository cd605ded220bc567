"""Near-duplicates and components against brute force."""

import random

import pytest

import corpus_pipeline
from dialoom.llm import near_dedup
from dialoom.llm.components import components

SCHEMA = "doc_id long, text string, n int, part string, c long"


def merged(pairs):
    above = {}

    def top(x):
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {x: top(x) for x in above}


def plain_sets(rows):
    sets = {}
    for doc_id, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for space in "\t\n\x0b\x0c\r":
            words = words.replace(space, " ")
        words = [w for w in words.split(" ") if w]
        sets[doc_id] = {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    return sets


def brute(rows, percent=85):
    sets = plain_sets(rows)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b] and
             100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    tops = merged(links)
    return sorted((d, len(sets[d]), tops.get(d, d), tops.get(d, d) == d) for d in ids)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    made = random.Random(seed)
    edges = [(made.randrange(90), made.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)]
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: t for x, t in merged((a, b) for a, b in edges if a != b).items()}


def test_groups_chains_and_odd_rows(spark):
    made = random.Random(4)
    words = [f"w{i}" for i in range(400)]

    def text(n):
        return [made.choice(words) for _ in range(n)]

    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One  TWO"), (5, "one two three four five"),
            (6, " one two"), (7, "É b c d e f"), (8, "é b c d e f")]
    for _ in range(6):  # copies with growing edits: chains around the threshold
        base = text(made.choice([40, 120, 400]))
        for _ in range(12):
            rows.append((len(rows), " ".join(base)))
            for _ in range(made.randint(0, 2)):
                base = list(base)
                base[made.randrange(len(base))] = made.choice(words)
    rows += [(len(rows) + i, " ".join(text(60))) for i in range(20)]
    made.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()))
    assert got == brute(rows)


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "z"), (None, "a b c d e f"), (None, None)],
                                 "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (None, 2, 1, False), (None, 0, None, False)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_bucket_blocks_lose_no_pair(spark, monkeypatch):
    """The last step alone, with tiny blocks, finds what the whole does."""
    monkeypatch.setattr(near_dedup, "STARS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_dealt_rows_grow_with_the_group(spark, monkeypatch):
    """Of a bucket that is one large part and a few strays, each member is copied a bounded number of times."""
    dealt = {}
    for block, n in ((16, 500), (16, 2000), (600, 500)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        members = spark.range(n).selectExpr("0 AS table", "7L AS key", "id AS c", "50 AS n", "IF(id % 200 = 199, id, 0L) AS part")
        marks = spark.range(n).selectExpr("id AS c", "array(1L) AS sketches", "binary('x') AS slots")
        rows = near_dedup._dealt(members, marks).collect()
        strays = {c for c in range(n) if c % 200 == 199}
        met = {(r.x, r.y): ([], []) for r in rows}
        for r in rows:
            if r.side != near_dedup.RIGHT:
                met[r.x, r.y][0].append(r.c)
            if r.side == near_dedup.RIGHT or r.side == near_dedup.BOTH and r.c in strays:
                met[r.x, r.y][1].append(r.c)
        pairs = [(a, b) for left, right in met.values() for a in left for b in right if a not in strays or a < b]
        assert sorted(pairs) == sorted((a, b) for b in strays for a in range(n) if a not in strays or a < b)
        dealt[block, n] = len(rows)
    assert dealt[16, 500] <= 2 * 500 and dealt[16, 2000] <= 2 * 2000 and dealt[600, 500] == 500


def test_one_row_of_each_group(spark):
    near = "a b c d e f g h i j"
    rows = [(None, near, 1), (2, near, 2), (2, "other words that stand alone here", 3), (1, near, 4), (1, near, 5), (None, "", 6), (None, None, 7),
            (3, " ", 8), (3, " ", 9), (None, "null ids near each other only", 10), (None, "null ids near each other only", 11), (0, "other words that stand alone here", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid int").coalesce(1)
    clashing = docs.selectExpr("*", "rid AS _staying", "rid AS _rid", "rid AS class")
    got = near_dedup.one_of_each(clashing)
    assert got.columns == clashing.columns
    assert sorted(r.rid for r in got.collect()) == [4, 6, 7, 8, 9, 10, 12]
    assert near_dedup.one_of_each(clashing.limit(0)).count() == 0


def test_similarities_that_are_not_found_are_refused():
    with pytest.raises(ValueError):
        near_dedup.side_of(50)


def test_bands_follow_the_similarity():
    assert (near_dedup.side_of(85), near_dedup.least_equal(85)) == (10, 84)
    assert (near_dedup.side_of(80), near_dedup.least_equal(80)) == (13, 75)


def test_pairs_from_80_to_84(spark):
    rows, similar = [], []
    for i in range(60):
        words = [f"p{i}w{j}" for j in range(204)]  # 200 shingles
        for k in (17, 18, 19, 20, 22, 23, 24):  # k changed at the end: (200 - k) / (200 + k)
            similar.append((200 - k) / (200 + k))
            own = [f"k{k}{w}" for w in words]
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(own[:-k] + [f"x{w}" for w in own[-k:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, one in ((85, {r.doc_id for r in near_dedup.one_of_each(docs).collect()}),
                         (80, {r.doc_id for r in corpus_pipeline.near_dedup_documents(spark, docs, "").collect()})):
        assert one == {d for d, _ in rows if d % 2 == 0 or 100 * similar[d // 2] < percent}
