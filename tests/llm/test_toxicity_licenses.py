"""Toxicity and licences: folding, matching, learning, held-out accuracy."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dialoom.llm import license_scan, toxicity

DATA = "/root/testdata/sf0.01"


def test_fold_and_hits():
    assert toxicity.fold("ѕtup1d ＩＤＩОT Clöwn") == "stupid idiot clown"
    lexicon = toxicity.Lexicon((("idiot ", 2.0), ("trash ", 1.0), ("lowe", 3.0)), ("trash can",), 1.0, 0.0)
    matcher = toxicity.Matcher(lexicon)
    found = [h[1] for h in matcher.hits(toxicity.fold("1d10t idiots, a trash can; TRA5H loweich flowe"))]
    assert found == ["idiot", "trash", "lowe"]
    assert toxicity.Matcher(toxicity.Lexicon((), (), 1.0, 0.0)).density("idiot") == (0.0, 0)
    long, short = matcher.density("idiot " + "word " * 5000)[0], matcher.density("idiot word")[0]
    assert 0 < long < short


def test_chosen_entries_do_not_overlap():
    ranked = [("lowei", 5.0), ("lowe", 5.0), ("loweich", 4.0), ("idiot ", 3.0), ("idio", 2.0), ("idle", 1.0)]
    assert toxicity.chosen(ranked) == {"lowei": 5.0, "idiot ": 3.0, "idle": 1.0}


def test_learns_from_its_fold_only(spark):
    made = random.Random(3)
    words = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]

    def text(bad):
        own = [made.choice(words) for _ in range(40)]
        if bad:
            own[made.randrange(40)] = made.choice(("blorg", "vexxu"))
        return " ".join(own)

    marks = [made.random() < 0.3 for _ in range(600)]
    rows = [(i, text(bad), "en", None) for i, bad in enumerate(marks)] + [(None, "blorg", None, 1), (9000, None, None, 1), (9001, "", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(marks)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert {e.strip() for e, _ in lexicon.weights} <= {"blorg", "vexxu", "blor", "vexx"}
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lexicon).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == int(bad) for i, bad in enumerate(marks))
    assert got[9000].score == got[9001].score < toxicity.THRESHOLD <= got[None].score
    held = [i for i in range(600) if got[i].held_out]
    assert 100 < len(held) < 200
    turned = spark.createDataFrame([(i, int(b) if i not in set(held) else 1 - int(b)) for i, b in enumerate(marks)],
                                   "doc_id long, toxic int")
    assert toxicity.learn(docs, turned) == lexicon
    empty = toxicity.learn(docs.limit(0), labels)
    assert empty.weights == () and toxicity.toxicity(docs.limit(0), empty).count() == 0


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity.toxicity(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    toxic = [r.score for r in rows if r.toxic == 1]
    assert sum(clean) <= 0.02 * len(clean)
    assert sorted(toxic)[len(toxic) // 2] >= toxicity.THRESHOLD


def test_large_lexicons_are_learned_whole(spark):
    made = random.Random(9)
    letters = "abcdefghijklmnoprstuvwz"
    words = sorted({"".join(made.choice(letters) for _ in range(9)) for _ in range(5000)})
    plain = ["".join(made.choice(letters) for _ in range(6)) for _ in range(400)]
    spread = [w for w in words for _ in range(110)]
    made.shuffle(spread)
    texts = [(" ".join([*spread[i:i + 300], *made.sample(plain, 30)]), 1) for i in range(0, len(spread), 300)]
    texts += [(" ".join(made.sample(plain, 60)), 0) for _ in texts]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")
    matcher = toxicity.Matcher(toxicity.learn(docs, labels))
    assert sum(bool(matcher.density(w)[1]) for w in words) >= 0.999 * len(words)
    assert not any(matcher.density(w)[1] for w in plain if not any(x.startswith(w[:5]) for x in words))


@pytest.fixture(scope="module")
def scanner(spark):
    return license_scan.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_families(spark, scanner):
    rows = [(1, "Intro.\nReleased under the MIT License.\nEnd."), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""),
            (5, "Nothing of the kind here, only a plain sentence about a licence."), (6, "words " * 30_000),
            (7, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."),
            (None, "Released under the MIT License."), (2, "Licensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, families string, words int")
    got = sorted(((r.doc_id, r.families) for r in license_scan.license_scan(docs, scanner).collect()), key=str)
    assert got == sorted([(1, "mit"), (2, "cc-by-nc"), (2, "cc-by-nc"), (3, ""), (4, ""), (5, ""), (6, ""),
                          (7, "apache-2.0,gpl"), (None, "mit")], key=str)
    assert license_scan.license_scan(docs.limit(0), scanner).count() == 0


def test_documents_with_license_lines(spark, scanner):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.families for r in license_scan.license_scan(docs, scanner).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "gpl", "Released under the MIT License.": "mit"}
    for r in docs.collect():
        want = {family for line, family in lines.items() if line in r.text.split("\n")}
        assert want <= set(got[r.doc_id].split(",")) and (want or got[r.doc_id] == "")


def test_statements_inside_long_lines(spark, scanner):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    words = [w for t in texts for line in t.split("\n") if not re.search("licen[sc]e|CC BY", line, re.I) for w in line.split()]
    made = random.Random(6)
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "gpl", "Released under the MIT License.": "mit"}
    rows, want = [], []
    for n in (20, 200, 2000):
        for line, family in lines.items():
            for _ in range(12):
                at = made.randrange(len(words) - n)
                rows.append((len(rows), " ".join([*words[at:at + n // 2], line, *words[at + n // 2:at + n]])))
                want.append((n, family))
    rows += [(len(rows) + i, " ".join(words[i * 3000:i * 3000 + 2000])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.families.split(",") for r in license_scan.license_scan(docs, scanner).collect()}
    for n in (20, 200, 2000):
        found = [family in got[i] for i, (size, family) in enumerate(want) if size == n]
        assert sum(found) >= 0.9 * len(found), n
    assert all(got[i] == [""] for i in range(len(want), len(rows)))


def test_windows_cover_lines(spark):
    sizes = [1, 63, 64, 65, 104, 105, 500]
    docs = spark.createDataFrame([(n, " ".join(str(i) for i in range(n)) + "\n \n..") for n in sizes], "n int, text string")
    rows = license_scan.windowed(docs, ("n",)).collect()
    whole = license_scan.WINDOW - license_scan.STRIDE + 1
    assert all(r.paragraph == 0 for r in rows)
    for n in sizes:
        spans = [(r.start, r.start + len(r.words)) for r in rows if r.n == n]
        assert all(r.words[0] == str(r.start) for r in rows) and max(b - a for a, b in spans) <= license_scan.WINDOW
        assert all(any(a <= i and min(i + whole, n) <= b for a, b in spans) for i in range(n))


def test_words(spark):
    texts = ["Version 2.0. (the License); v.3.", "C++ a..b .net É-ü", "...", "", None, "x" * 9000, "GPL-3.0-or-later!"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.w for r in docs.select(license_scan.normal_words(F.col("text")).alias("w")).collect()]
    assert got == [["version", "2.0", "the", "license", "v.3"], ["c++", "a", ".b", ".net", "é", "ü"], [], [], [], ["x" * 9000],
                   ["gpl", "3.0", "or", "later"]]


def test_near_misses(spark, scanner):
    texts = {
        "This library is distributed under the GNU Lesser General Public License, version 3.": {"lgpl"},
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": {"cc-by-sa"},
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"cc-by"},
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": {"cc-by-nd"},
        "This project is licensed under the ISC License.": {"isc"}, "This project is licensed under the MIT License.": {"mit"},
        "Licensed under CC BY-SA 4.0.": {"cc-by-sa"}, "Licensed under CC BY 4.0.": {"cc-by"},
        "This work is licensed under the GNU Affero General Public License, version 3.": {"agpl"}}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: set(r.families.split(",")) - {""} for r in license_scan.license_scan(docs, scanner).collect()}
    for i, (text, want) in enumerate(texts.items()):
        assert got[i] <= want, text
    assert sum(got[i] == want for i, want in enumerate(texts.values())) >= 0.8 * len(texts)


def test_other_licences_are_no_family(spark, scanner):
    names = ["Artistic License 2.0", "Boost Software License", "SIL Open Font License", "PostgreSQL License", "Microsoft Public License",
             "Zope Public License", "Academic Free License", "Open Software License", "Python Software Foundation License", "Ruby License"]
    ways = ["Licensed under the {}.", "This project is licensed under the {}.", "Released under the {}.", "This work is licensed under the {}, version 3.",
            "This software may be used under the terms of the {}.", "All files here are covered by the {}."]
    fillers = ["", "See the file for details. ", "We thank all authors of this work. ", "Copyright by the authors. ", "Please read this. "]
    texts = [f + w.format(n) for n in names for w in ways for f in fillers]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    false = [(texts[r.doc_id], r.families) for r in license_scan.license_scan(docs, scanner).collect() if r.families]
    assert len(false) < 0.01 * len(texts), false[:5]


def plain_judged(windows, least):
    """Families of windows with given probabilities, by plain reading."""
    templates = {f: [set(re.findall(r"[a-z0-9+]+(?:\.[a-z0-9+]+)*", t.lower())) for t in ts] for f, ts in license_scan.TEMPLATES.items()}
    users = Counter(w for ts in templates.values() for w in set().union(*ts))

    def shares(words):
        def one(t):
            rarest = {w for w in t if users[w] == min(users[x] for x in t)}
            matched = round(sum(1 / users[w] for w in t & words), 6) if 2 * len(rarest & words) >= len(rarest) else 0.0
            return min(matched / round(sum(1 / users[w] for w in t), 6), len(t & words) / len(t)), matched

        return {f: max(map(one, ts)) for f, ts in templates.items()}

    found = []
    for w in windows:
        if w.chances is not None and 1 - w.chances[0] >= least:
            probability = max(w.chances[1:])
            found.append((w, list(templates)[list(w.chances[1:]).index(probability)], probability, shares(set(w.words))))
    best = {}
    for w, family, probability, own in found:
        cut = any(x["_row"] == w["_row"] and x.paragraph == w.paragraph and abs(x.start - w.start) < license_scan.WINDOW
                  and other != family and theirs[family][0] > own[family][0] for x, other, _, theirs in found)
        if not cut:
            sure = own[family][0] >= 0.6 and not any(
                own[f][0] >= 0.6 and own[f][1] > own[family][1] and 10 * p >= probability for f, p in zip(templates, w.chances[1:]))
            key = (w["_row"], w.doc_id, w.paragraph, family)
            best[key] = max(best.get(key, (False, 0.0, 0.0)), (sure, own[family][0], probability))
    return sorted((doc, par, fam, round(p, 6), round(r, 6), sure) for (_, doc, par, fam), (sure, r, p) in best.items())


def test_judgement_against_a_plain_reading(spark, scanner):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(10_000 + i, " ".join([*["word"] * (i * 7), *texts, *["other"] * 30])) for i, texts in enumerate(
        ts for family in license_scan.TEMPLATES.values() for ts in (family, family[:1], family[-1:]))]
    windows = license_scan.scored(docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")), scanner)
    got = sorted((r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.resemblance, 6), r.confirmed)
                 for r in license_scan.judged(windows, 0.5).collect())
    want = plain_judged(windows.where("chances IS NOT NULL").collect(), 0.5)
    assert got == want and sum(r[-1] for r in want) > 20


def test_empty_training_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.license_scan(docs).count() == 0
