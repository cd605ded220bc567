"""URL rules against plain readings, and mined rules against all combinations of tokens."""

import random
import re
from collections import Counter
from fractions import Fraction
from itertools import combinations

from pyspark.sql import functions as F

from dialoom.llm import url_rules

SMALL = "/root/testdata/sf0.001"
FIXED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def plain_read(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = re.split("[?#]", url[url.index("://") + 3:])[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in FIXED if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
    return host, slash + path, max(fits)[1:] if fits else None


def plain_rules(labelled, least, least_confidence):
    """Rules as {(items, verdict): (confidence, support)}, special cases of others left out."""
    counts, n = Counter(), len(labelled)
    for tokens, verdict in labelled:
        for size in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), size):
                counts[some, None] += 1
                counts[some, verdict] += 1
    found = {(some, v): (Fraction(c, counts[some, None]), c) for (some, v), c in counts.items() if v and c >= least
             and c / counts[some, None] >= least_confidence}
    return {(s, v): (float(c), k / n) for (s, v), (c, k) in found.items() if not any(
        v == w and set(r) < set(s) and d >= c for (r, w), (d, _) in found.items())}


def judged(pages):
    return sorted(map(tuple, url_rules.judge(pages).collect()), key=str)


def test_reading_and_fixed_rules(spark):
    urls = [None, "", "no scheme", "http://NET", "http://net/", "http://a.NET/x?y#z", "https://xnet/", "ftp://Example.NET/en/1", "http://b.example.net/en",
            "http://net:80/", "://net/", "http://a.org/fr/?q", "http://org/fr/#x/y", "http://a.example.com/de/9", "http://example.com.de/de/",
            "http://example.com?x://b.net/", "http://u@a.net/p", "http:///en/", "x://y://z.net/", "http://a.net#/b", "http://é.NET/É?"]
    pages = spark.createDataFrame([(i, u, "h", "r", "v", 1.5, ["t"]) for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, rule string, verdict string, path double, tokens array<string>")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages).collect()}
    for i, url in enumerate(urls):
        host, path, fixed = plain_read(url)
        assert got[i] == (host, path, fixed and fixed[1], fixed[0] if fixed else "allow"), url


def test_mined_rules_are_those_of_all_combinations(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    read = url_rules.read_urls(pages).where("fixed IS NOT NULL").select(
        "tokens", F.when(F.col("fixed") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    rows = [(tuple(r.tokens), r.verdict) for r in read.collect()]
    got = {(tuple(r["items"]), r.verdict): (round(r.confidence, 9), round(r.support, 9))
           for r in url_rules.mine(read, 0.01, 8, 0.75).collect()}
    want = plain_rules(rows, max(0.01 * len(rows), 8), 0.75)
    assert want and got == {k: (round(c, 9), round(s, 9)) for k, (c, s) in want.items()}


def test_rules_of_more_tokens_than_fp_growth_combines(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(600):  # the verdict hangs on a pair of the tokens that tell least alone
        a, b = rng.random() < 0.5, rng.random() < 0.5
        verdict = "block" if (a == b) != (rng.random() < 0.02) else "allow"
        some = [f"t{i}" for i in range(9) if verdict == "block" or rng.random() < 0.75]
        rows.append((some + ["u"] * a + ["w"] * b, verdict))
    got = {(tuple(r["items"]), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in url_rules.mine(
        spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 8, 0.9).collect()}
    want = plain_rules(rows, 30, 0.9)
    assert (("u", "w"), "block") in want
    assert got == {k: (round(c, 9), round(s, 9)) for k, (c, s) in want.items()}


def test_mined_rules_judge_other_urls(spark):
    urls = [f"http://w{i}.pills.example.net/de/{i}" for i in range(60)] + [f"https://news.example.net/en/{i}?page=1" for i in range(60)]
    urls += ["http://www.pills.example.org/x", "http://news.example.com/a?page=2", "ftp://new.example.com/", "http://w1.pills.news.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.mined) for r in url_rules.judge(pages).collect()}
    assert got[120][:2] == (None, "block") and "h:pills" in got[120][2]
    assert got[121][:2] == (None, "allow") and got[121][2]
    assert got[122] == (None, "allow", None)


def test_many_tokens_and_repeated_rows(spark):
    deep = "http://a.net/" + "/".join(f"s{chr(97 + i)}" for i in range(25))  # 2 ** 25 combinations, were all mined
    rows = [(1, f"{deep}#{i // 2}") for i in range(80)] + [(None, deep), (2, "http://b.com/" + "/".join("x" * 2000)), (3, "http://b.com/sx/sy"), (4, "x" * 50_000)]
    rows += [(i, f"http://c.example.net/en/{i}") for i in range(10, 60)]
    got = judged(spark.createDataFrame(rows, "page_id long, url string"))
    assert len(got) == len(rows) and sum(r[0] == 1 and r[4] == "block" for r in got) == 80
    assert [r[4] for r in got if r[0] == 3] == ["block"]


def test_empty_table(spark):
    assert judged(spark.createDataFrame([], "page_id long, url string")) == []


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_rules.judge(pages).collect()}
    assert got == {r.page_id: (*plain_read(r.url)[:2], (plain_read(r.url)[2] or (None, None))[1]) for r in pages.collect()}
