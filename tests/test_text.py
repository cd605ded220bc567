from pyspark.sql import functions as F

from checks import queries as registered
from dialoom.functions import names as nm
from dialoom.functions import text as tx
from dialoom.functions import wordlists as wl
from dialoom.operators import pages as pg


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_contraction_rules():
    assert len(wl.spaced_rules()) == 122 and len(wl.apostrophe_rules()) == 124
    order = [p for p, _ in wl.apostrophe_rules()]
    assert order.index("can't") < order.index("'cause") < order.index("could've")
    assert order.index("em'") < order.index("'em") < order.index("hadn't")


def test_expand_contractions(spark):
    cases = {"can't've": "cannot've", "they’d go": "they would go", "i'd've": "i would have",
             " he d ve ": " he would have ", "y'all'd": "you all'd", "you'll": "you will",
             " don t ": " don t ", "plain": "plain"}
    assert values(spark, list(cases), tx.expand_contractions) == list(cases.values())


def test_gate_never_changes_the_result(spark):
    texts = [p + "x" for p, _ in wl.spaced_rules()] + [p for p, _ in wl.apostrophe_rules()]
    want = []
    for text in texts:
        for pattern, full in [("’", "'"), *wl.spaced_rules(), *wl.apostrophe_rules()]:
            text = text.replace(pattern, full)
        want.append(text)
    assert values(spark, texts, tx.expand_contractions) == want


def test_normalize_and_tokenize(spark):
    assert values(spark, ["King g'day  m' x s y"], tx.normalize_text) == ["king good day my xs y"]
    got = values(spark, ["the king's gold, cannot well-known (u.s.) 1,000 105 naïve"], tx.tokenize)
    assert got == [["the", "king", "s", "gold", "can", "not", "wellknown", "us", "one thousand",
                    "one hundred and five", "naïve"]]


def test_number_words(spark):
    cases = {"42": "forty-two", "105": "one hundred and five", "0": "zero", "007": "seven", "1000": "one thousand",
             "1234": "one thousand, two hundred and thirty-four", "1005": "one thousand and five", "12a": "12a",
             "2000017": "two million and seventeen"}
    assert values(spark, list(cases), tx.number_words) == list(cases.values())


def test_punctuate(spark):
    assert values(spark, ["Hello", "Why?", "", "a|"], tx.punctuate) == ["Hello.", "Why?", ".", "a|"]


def test_possessive_fold(spark):
    assert values(spark, ["king_s_landing", "king_s", "iron_throne"], tx.fold_possessive) == [
        "kings_landing", "kings", "iron_throne"]


def test_sentence_length_weight(spark):
    got = values(spark, ["a b c d e f", "aa bb cc dd ee ff", "aa bb cc dd ee ff gg hh"], tx.sentence_length_weight)
    assert [round(v, 6) for v in got] == [0.0, 1.0, 1.693147]


def test_speaker_parse(spark):
    lines = ["JON (quietly): I said: no", "the door opens"]
    assert values(spark, lines, pg.speaker) == ["JON", ""]
    assert values(spark, lines, pg.quote) == ["no", ""]


def test_name_ratios(spark):
    rows = spark.createDataFrame([("CERSEI", "CERSI"), ("RAMSAY", "RAMSEY")], "a string, b string")
    assert [r[0] for r in rows.select(nm.ratio(F.col("a"), F.col("b"))).collect()] == [91, 83]
    held = spark.createDataFrame([("JON", "JON THE BRAVE"), ("JON", "JO"), ("JON", "NED")], "a string, b string")
    assert [r[0] for r in held.select(nm.contained(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_references(spark):
    cases = {"a &lt;b&gt; &amp;lt; &#39;&#x27;&#X2019;": "a <b> &lt; ''’", "&#233;&eacute;&#128512;": "éé😀", "&#150;&#x81;": "–\x81",
             "&#0;&#xD800;&#1114112;&#99999999999;": "�" * 4, "&#00000000065;": "A", "&nope; &lt & &#; &;": "&nope; &lt & &#; &;",
             "": "", "line\n&nbsp;two": "line\n two"}
    assert values(spark, list(cases), pg.decode_references) == list(cases.values())
    assert values(spark, [None], pg.decode_references) == [None]


def test_numbers_of_large_keys(spark, tmp_path):
    keys = [1, 3_037_001, 9_000_000, None]
    spark.createDataFrame([(k, 1, 7) for k in keys], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    got = {r.k: r.words for r in registered.queries()["number_words"](spark, str(tmp_path)).collect()}
    told = spark.createDataFrame([(k, str(k * k * 1000003 % 1000000007 * 7)) for k in keys if k], "k long, token string")
    assert got == {r.k: r.words for r in told.select("k", tx.number_words(F.col("token")).alias("words")).collect()} | {None: None}
