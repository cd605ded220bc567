"""Joins by pieces against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from dialoom.operators import names as nm
from dialoom.operators import speakers as sp
from dialoom.params import NameParams


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        done = [0]
        for j, y in enumerate(b):
            done.append(row[j] + 1 if x == y else max(row[j + 1], done[j]))
        row = done
    return row[-1]


def ratio(a, b):
    return int(200 * common(a, b) / (len(a) + len(b)) + 0.5)


def partial(a, b):
    a, b = sorted((a, b), key=len)
    return 100 if not a else max(ratio(a, b[i:i + len(a)]) for i in range(len(b) - len(a) + 1))


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        done = [i + 1]
        for j, y in enumerate(b):
            done.append(min(row[j + 1] + 1, done[j] + 1, row[j] + (x != y)))
        row = done
    return 100 * (1 - row[-1] / max(len(a), len(b)))


@pytest.fixture(scope="module")
def cast(spark):
    rng = random.Random(5)
    known = ["JON", "CERSEI", "TYRION L", "A", "DAENERYS TARGARYEN", "MAN AT ARMS NUMBER SEVENTEEN", "ÉOWYN", ""]
    names = {"", "JON", "JO", "J", "CERSEICERSEI", "OLD MAN AT ARMS NUMBER SEVENTEENTH"}
    for name in known * 12:
        letters = list(name)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(letters))
            letters[at:at + rng.randint(0, 1)] = rng.choice(["", "E", "N", "R", " "])
        names.add("".join(letters))
    names = sorted(names)
    aliases = spark.createDataFrame([("s", k, i, None) for i, k in enumerate(known)] + [("t", "JON", 0, None)],
                                    "show string, canonical string, canon_ord int, alias string")
    rows = spark.createDataFrame([("s", n) for n in names] + [("t", "JOHN"), (None, "JON"), ("s", None)],
                                 "show string, character_name string")
    pairs = [("s", n, k) for n in names for k in known if k] + [("t", "JOHN", "JON")]
    return rows, aliases, pairs


def found(df):
    rows = [(r.show, r.character_name, r.canonical) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("least", [50, 80, 90, 100])
def test_names_alike(spark, cast, least):
    names, aliases, pairs = cast
    p = NameParams(min_ratio=least)
    assert found(nm.fuzzy_matches(names, aliases, p)) == {x for x in pairs if ratio(x[2], x[1]) >= least}
    assert found(nm.edit_matches(names, aliases, p)) == {x for x in pairs if edit(x[2], x[1]) >= least - 1e-9}


@pytest.mark.parametrize("least", [70, 85, 100])
def test_names_alike_in_part(spark, cast, least):
    names, aliases, pairs = cast
    want = {x for x in pairs if x[1] and max(partial(x[2] + " ", x[1]), partial(" " + x[2], x[1])) >= least}
    assert found(nm.partial_matches(names, aliases, NameParams(min_partial_ratio=least))) == want


def test_few_names_are_measured(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ABCDEFGHIJKLMNOP") for _ in range(12)) for _ in range(200)]
    names = spark.createDataFrame([("s", w[1:] + "Z") for w in words], "show string, character_name string")
    aliases = spark.createDataFrame([("s", w, i, None) for i, w in enumerate(words)],
                                    "show string, canonical string, canon_ord int, alias string")
    likely = nm.name_candidates(names, aliases, lambda m, n: F.floor((m + n) * 0.105))
    assert 200 <= likely.count() < 2000


def test_pairs_are_measured_once(spark, cast):
    names, aliases, _ = cast
    for df in (nm.partial_matches(names, aliases, NameParams(min_partial_ratio=70)), nm.fuzzy_matches(names, aliases)):
        steps = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = [i for i, step in enumerate(steps) if "EvalPython" in step]
        # what makes the pairs distinct, and their join, come before
        assert len(at) == 1 and not any("Join" in step or "Generate" in step for step in steps[:at[0]])


SENTENCE = "show string, episode string, pos int, sentence string"
LINE = "show string, episode string, line_no int, character_name string, narration string"


@pytest.mark.parametrize("few", [0, sp.FEW_LINES, 10**6])
def test_lines_that_hold_a_sentence(spark, monkeypatch, few):
    monkeypatch.setattr(sp, "FEW_LINES", few)
    rng = random.Random(2)
    words = ["we", "go", "on", "to", "the", "wall", "a", "an", "ant"]
    lines = [("s", rng.choice("ef"), i, "A", rng.choice(["", " ", "  "]).join([" ".join(rng.choices(words, k=rng.randint(0, 9))), "end"]))
             for i in range(150)] + [("s", "e", 150, None, None), (None, "e", 151, "B", "we go"), ("s", "e", 0, "C", "the  wall")]
    texts = ["", " ", "go", "a", "an", "we go", "o t", " the", "the ", "on  to the", "go on to", "wall the a an", "nothing of that kind", "end",
             "we  go", "x" * 40, *[" ".join(rng.choices(words, k=k)) for k in (2, 3, 3, 3, 4, 4, 5)]]
    wanted = [("s", e, i, t) for e in "efg" for i, t in enumerate(texts)] + [("s", "e", 90, None), (None, "e", 91, "we go"), ("s", "e", 92, "go")]

    def squeezed(text):
        while "  " in text:
            text = text.replace("  ", " ")
        return text

    want = sorted((e, pos, no, str(who)) for s, e, pos, t in wanted if t is not None and s for z, f, no, who, n in lines
                  if n is not None and (s, e) == (z, f) and squeezed(t) in squeezed(n))
    got = sp.speaker_matches(spark.createDataFrame(wanted, SENTENCE), spark.createDataFrame(lines, LINE)).collect()
    assert sorted((r.episode, r.pos, r.line_no, str(r.character_name)) for r in got) == want


def test_few_lines_are_tried(spark):
    rng = random.Random(3)
    lines = [("s", "e", i, f"every line is like line w{i} of w{rng.randrange(1000)} here") for i in range(1000)]
    spoken = spark.createDataFrame(lines, "show string, episode string, spoken_id int, spoken string")
    wanted = spark.createDataFrame(lines[::5], "show string, episode string, wanted_id int, wanted string")
    pairs = sp.containing_candidates(wanted, spoken)
    assert pairs.count() == pairs.distinct().count() < 1000   # of 200,000 pairs


def test_no_sentence_and_no_line(spark, monkeypatch):
    monkeypatch.setattr(sp, "FEW_LINES", 0)
    none, some = spark.createDataFrame([], SENTENCE), spark.createDataFrame([("s", "e", 1, "A", "hi")], LINE)
    assert sp.speaker_matches(none, some).count() == 0
    one = spark.createDataFrame([("s", "e", 1, "hi")], SENTENCE)
    assert sp.speaker_matches(one, some.limit(0)).count() == 0
