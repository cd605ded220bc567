import json

import pytest

from dialoom.operators import documents as dc
from dialoom.operators import names as nm
from dialoom.operators.speakers import speaker_labels
from dialoom.operators.terms import keyphrase_candidates
from dialoom.params import KeyphraseParams
from dialoom.plans import results as rs
from dialoom.sources import tables as tb


def script(spark, rows):
    data = [(n, t, t, "s", e, season, "u", i) for i, (n, t, e, season) in enumerate(rows)]
    return spark.createDataFrame(data, tb.LINE_SCHEMA)


def test_aliases_and_stage_directions(spark, tmp_path):
    path = tmp_path / "names.json"
    path.write_text(json.dumps({"JON": ["JOHN"], "": ["EXT"], "NED": []}, indent=1))
    aliases = tb.load_aliases(spark, str(path), "s")
    assert [(r.canonical, r.canon_ord, r.alias) for r in aliases.collect()] == [
        ("JON", 0, "JOHN"), ("", 1, "EXT"), ("NED", 2, None)]
    lines = script(spark, [("JOHN", "hi", "e", 1), ("EXT", "Night", "e", 1), ("NED THE OLD", "no", "e", 1)])
    got = nm.resolve_names(lines, aliases).orderBy("line_no").collect()
    assert [(r.character_name, r.line, r.narration) for r in got] == [
        ("JON", "hi", "hi"), ("", "", "Night"), ("NED", "no", "no")]


def test_documents_across_segments(spark, monkeypatch):
    monkeypatch.setattr(dc, "SEGMENT_LINES", 2)
    lines = script(spark, [("A", f"w{i}", "e", 1) for i in range(7)])
    assert dc.episode_documents(lines).first().text == "w0. w1. w2. w3. w4. w5. w6."


def test_speaker_labels(spark):
    lines = script(spark, [("A", "one two", "e", 1), ("B", "two", "e", 1), ("C", "two", "e", 1), ("B", "one", "e", 1)])
    summary = spark.createDataFrame([("s", "e", 0, "one two"), ("s", "e", 1, "one"), ("s", "e", 2, "two"),
                                     ("s", "e", 3, "four")], "show string, episode string, pos int, sentence string")
    got = {r.pos: r.label for r in speaker_labels(summary, lines).collect()}
    assert got == {0: "A: one two", 1: "A and B: one", 2: "A, B, C: two", 3: "four"}


def test_materialize_once(spark, tmp_path):
    path, calls = str(tmp_path / "data"), []

    def build():
        calls.append(1)
        return spark.range(3)

    def fails():
        raise OSError("no such source")

    for _ in range(2):
        assert tb.materialize_once(spark, path, build).count() == 3
    assert len(calls) == 1
    assert tb.first_available(spark, str(tmp_path / "other"), fails, build).count() == 3


def test_results_replace_only_their_kind(spark, tmp_path):
    path = str(tmp_path / "results")
    for kind, item in (("a", "old"), ("b", "kept"), ("a", "new")):
        tb.put_results(spark.createDataFrame([("s", kind, "e", 1, item, 0.5)], tb.RESULT_SCHEMA), path)
    assert tb.get_results(spark, path, "s", "a", "e").first().item == "new"
    assert tb.get_results(spark, path, "s", "b").first().item == "kept"


def test_tables_and_schema(spark):
    tb.drop_table(spark, "dialoom_lines")
    tb.create_table(spark, "dialoom_lines")
    tb.append_table(script(spark, [("A", "it’s\tso", "e", 1)]), "dialoom_lines")
    assert spark.table("dialoom_lines").first().narration == "it's so"
    tb.drop_table(spark, "dialoom_lines")
    assert not spark.catalog.tableExists("dialoom_lines")
    with pytest.raises(ValueError):
        tb.check_schema(spark.range(1), tb.LINE_SCHEMA)


def test_settings_per_show(spark):
    rows = [(n, "x", "x", show, "e", 1, "u", i) for i, (show, n) in enumerate(
        [(s, n) for s in ("a", "b", "c") for n in ["MAN"] * 4 + ["JON"] * 3 + ["NED"] * 2 + ["SAM"]])]
    lines = spark.createDataFrame(rows, tb.LINE_SCHEMA)
    settings = spark.createDataFrame([("a", 1, None, None, None), ("b", None, ["JON"], None, None)], rs.SETTINGS)
    found = {}
    for r in dc.top_speakers(lines, 2, settings=settings).orderBy("show", "rank").collect():
        found.setdefault(r.show, []).append(r.character_name)
    assert found == {"a": ["JON"], "b": ["MAN", "NED"], "c": ["JON", "NED"]}
    texts = spark.createDataFrame([(c, i, t) for c in "ab" for i, t in enumerate(["red fox runs home", "blue fox sleeps long"])],
                                  "corpus string, doc_id long, text string")
    decay = spark.createDataFrame([("b", None, None, False, None)], rs.SETTINGS)
    plain = {c: keyphrase_candidates(texts, KeyphraseParams(term_len_decay=c == "a")).where(f"corpus = '{c}'") for c in "ab"}
    got = sorted(map(tuple, keyphrase_candidates(texts, settings=decay).select(*plain["a"].columns).collect()))
    assert got == sorted(map(tuple, plain["a"].unionByName(plain["b"]).collect()))


def test_only_missing_results_are_built(spark, tmp_path):
    path, asked = str(tmp_path / "results"), []

    def rows(entities, item):
        return spark.createDataFrame([("s", kind, e, 1, item, 0.5) for kind, e in entities], tb.RESULT_SCHEMA)

    def build(missing):
        asked.append(sorted((r.kind, r.entity) for r in missing.collect()))
        return rows({*asked[-1], ("a", "other"), ("a", "e1")}, "new")

    one, two = [("a", "e1"), ("b", "e1")], [("a", "e1"), ("a", "e2"), ("c", "e3")]
    for entities in (one, two, one, two):
        got = tb.results_or_build(spark, path, rows(entities, "").select(*tb.ENTITY), build)
        assert sorted((r.kind, r.entity) for r in got.collect()) == sorted(entities)
    assert asked == [sorted(one), [("a", "e2"), ("c", "e3")]]
    tb.put_results(rows([("a", "e1")], "put"), str(tmp_path / "put"))
    kept = tb.results_or_build(spark, str(tmp_path / "put"), rows(two, "").select(*tb.ENTITY), build)
    assert sorted((r.entity, r["item"]) for r in kept.collect()) == [("e1", "put"), ("e2", "new"), ("e3", "new")]
