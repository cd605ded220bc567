"""The filter audit against applying every order to the documents."""

from itertools import permutations

from dialoom.llm import filter_audit

SMALL = "/root/testdata/sf0.001"
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed_letters(text, smaller):
    words, found = [""], ""
    for c in text:
        words = words + [""] if c in " \t\n\x0b\x0c\r" else words[:-1] + [words[-1] + c]
    words = [w for w in words if w]
    found += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    found += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
    return found + "E" * smaller


def plain_audit(docs, labels):
    rows = [(i, text or "", lang or "") for i, text, lang in docs]
    fails = [failed_letters(text, i is not None and any(t == text and j is not None and j < i for j, t, _ in rows))
             for i, text, _ in rows]
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    out = []
    for part in {p for *_, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, fails) if p == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                steps.append((part, order, step, len(left), len(gone), sum(letter in f for _, f in own) - len(gone),
                              sum(f == letter for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def found(docs, labels):
    return sorted(map(tuple, filter_audit.audit(docs, labels).collect()))


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = found(docs, labels)
    assert got == plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()],
                              [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert len(got) == 600 * len({r[0] for r in got})


def test_shapley_values_share_what_all_filters_remove(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = filter_audit.audit(docs, labels).collect()
    for part in {r.part for r in rows}:
        first = [r for r in rows if r.part == part and r.filter_order == "ABCDE"]
        assert sum(r.shapley for r in first) == 120 * sum(r.removed for r in first)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, None, None), (2, "", "en"), (None, "", "en"), (None, None, "de"), (5, "same text", "en"), (5, "same text", "en"),
            (5, "same text", "de"), (4, "same text", "fr"), (6, "Same\x0bTEXT # x", "en"), (7, long, "en"), (8, long, "en"),
            (9, "a b " * 200, "xx"), (9, "\u00a0É É", "xx"), (3, "same text", None)]
    labels = [(5, 1, 0), (5, 0, 1), (6, None, 1), (None, 1, 1), (7, 1, None), (99, 1, 1)]
    more = [(*d, "n", 3, True) for d in docs]
    frame = spark.createDataFrame(more, "doc_id long, text string, lang string, part string, failed int, same boolean")
    told = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, of int")
    assert found(frame, told) == plain_audit(docs, labels)
    assert found(frame, told.limit(0)) == plain_audit(docs, [])
    assert found(frame.limit(0), told) == []
