"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

The vocabulary is compared with itself by sorted-list dynamic programming. A list of words is scanned in
sorted order; of the table of edit distances to a word sought, only the three cells around the diagonal
are kept per row, and the rows that a list word shares with its predecessor, as many as their common
prefix has code points, are used again. As soon as no cell of a row is at most 1, all further words with
that prefix are skipped.

So that no task needs the whole list, it is cut where one edit cannot reach: cut the shorter word of a pair
in two, and one edit leaves either the front or the back of both words equal. Words of length m and m + 1
meet by their fronts of m // 2 code points, and by their backs, for pairs with unequal fronts. A list
longer than BLOCK is cut again in the same way, between the equal front and back, until at most two code
points of its words differ.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.base import written

LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
#: Of runs hashed with their doc_id, every MISSPELT-th loses a code point.
MISSPELT = 199
#: Maximal runs of letters that are long enough; shorter ones give no word.
RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}")
#: Words counted in a task before they are handed on.
HELD = 200_000
BLOCK = 4096
LAST = "\U0010ffff"


def runs_of(doc_id: int | None, text: str | None) -> Counter[str]:
    """Counts of the words of a text, one run in MISSPELT misspelt; a null doc_id is written as nothing."""
    lowered = (text or "").encode().lower().decode()  # of bytes, only A-Z change
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter[str] = Counter()
    for run, n in Counter(RUN.findall(lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_CHARS:
                continue
        found[run] += n
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with at least LEAST_COUNT occurrences in all documents."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in source:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.update(runs_of(doc_id, text))
                if len(held) > HELD:
                    yield handed()
        yield handed()

    return (docs.select("doc_id", "text").mapInArrow(batches, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))


#: What the words of a list share: m, the length of the shorter word of a pair; a and b, how many code
#: points in front and at the back are equal, and these; and how long a common prefix a pair may not have,
#: as it is then found by another list.
KEY = ("m", "a", "b", "below", "front", "back")


def _halved(lists: DataFrame) -> DataFrame:
    """Every list cut in two: by the front half of what is not yet equal, and by the back half."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    back = F.col("m") - F.col("a") - half
    ends = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("below").alias("below")),
                   F.struct(F.col("a").alias("a"), back.alias("b"), (F.col("a") + half).alias("below")))
    return (lists.select("word", "n", "m", F.explode(ends).alias("end"))
            .select("word", "n", "m", "end.*")
            .select("word", "n", *KEY[:4], F.expr("left(word, a)").alias("front"), F.expr("right(word, b)").alias("back")))


def lists(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, KEY): every word in the lists in which it can meet a near one.

    No list is longer than block, or than the words there can be that differ in two code points.
    """
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length - 1, length)).alias("m")).where(
        F.col("m") >= LEAST_CHARS).select(
        "word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b"), (F.col("m") + 2).alias("below"))
    done, open_lists = None, _halved(whole)
    while True:
        open_lists = written(open_lists, "spelling-lists")
        long = written(open_lists.where("m - a - b >= 2").groupBy(*KEY).count().where(F.col("count") > block)
                       .drop("count"), "spelling-long")
        if long.isEmpty():
            return open_lists if done is None else done.unionByName(open_lists)
        fits = open_lists.join(long, list(KEY), "left_anti")
        done = fits if done is None else done.unionByName(fits)
        open_lists = _halved(open_lists.join(long, list(KEY), "left_semi"))


def near_in_list(sought: str, sorted_words: list[str]) -> Iterator[int]:
    """Places in the sorted list of the words at an edit distance of 1.

    rows[d] has the cells d - 1, d and d + 1 of row d, the distances of the first d code points of a list
    word to as many of the word sought; 2 stands for 2 and more.
    """
    size, last = len(sought), len(sorted_words)
    rows = [(2, 0, 1 if size else 2)]
    at, before = 0, ""
    while at < last:
        word = sorted_words[at]
        depth, most = 0, min(len(rows) - 1, len(word))
        while depth < most and word[depth] == before[depth]:
            depth += 1
        del rows[depth + 1:]
        before = word
        low, mid, high = rows[depth]
        for d in range(depth, len(word)):
            c = word[d]
            x = 2 if d > size else mid + 1
            if 0 < d <= size and sought[d - 1] == c and low < x:
                x = low
            elif 0 < d <= size and low + 1 < x:
                x = low + 1
            y = 2
            if d < size:
                y = min(mid + (sought[d] != c), high + 1, x + 1)
            z = 2
            if d + 1 < size:
                z = min(high + (sought[d + 1] != c), y + 1)
            low, mid, high = x, y, z
            rows.append((x, y, z))
            if x > 1 and y > 1 and z > 1:
                at = bisect_right(sorted_words, word[:d + 1] + LAST, at + 1)
                break
        else:
            cell = size - len(word) + 1
            if 0 <= cell <= 2 and rows[-1][cell] == 1:
                yield at
            at += 1


def near_pairs(listed: DataFrame) -> DataFrame:
    """(word, near, n, near_n) of all near words, each pair in both directions, once."""

    def pairs(key: tuple, rows: list[tuple[str, int]]) -> Iterator[tuple[str, str, int, int]]:
        m, a, b, below = key[:4]
        inner = sorted((word[a:len(word) - b], word, n) for word, n in rows)
        middles = [x[0] for x in inner]
        for middle, word, n in inner:
            if len(word) != m:
                continue
            for at in near_in_list(middle, middles):
                _, other, other_n = inner[at]
                if (len(other) > m or word < other) and word[:below] != other[:below]:
                    yield word, other, n, other_n

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def out(found: list[tuple]) -> pa.RecordBatch:
            both = found + [(y, x, n, k) for x, y, k, n in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in both], kind) for i, kind in enumerate(
                    (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["word", "near", "n", "near_n"])

        for batch in source:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2:] != group:
                    if len(rows) > 1:
                        found += pairs(group, rows)
                    group, rows = row[2:], []
                rows.append(row[:2])
            yield out(found)
        if len(rows) > 1:
            yield out(list(pairs(group, rows)))

    return (listed.select("word", "n", *KEY).repartition(*KEY).sortWithinPartitions(*KEY)
            .mapInArrow(batches, "word string, near string, n long, near_n long"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): where following the forms ends.

    A form is TIMES as frequent as its word at least, so paths are short and have no circle; every round
    halves what is left of them.
    """
    ends = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = written(ends.join(step, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        ends = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return ends


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    n_near counts the near words. form is the most frequent of them, the first in code-point order of
    equally frequent ones, if it is TIMES as frequent as the word; root is where the forms lead. Null and
    empty texts have no words, repeated rows count each, a null doc_id is hashed as an empty one, other
    columns are not read; an empty table, or one without frequent words, gives no rows.
    """
    words = written(vocabulary(docs), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    nearest = near_pairs(lists(words)).groupBy("word").agg(F.count("*").alias("n_near"), best).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    often = F.col("near_n") >= TIMES * F.col("n")
    found = written(words.join(nearest, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("near")).alias("form"),
        F.when(often, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc32_sql(string: str) -> str:
    """The unsigned crc32 of a string for DuckDB, byte by byte with a table of half bytes."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    steps = f"({table}::BIGINT[])"
    codes = (f"list_transform(range(octet_length(encode({string}))), "
             f"lambda i: ('0x' || substr(hex(encode({string})), 2 * i + 1, 2))::BIGINT)")

    def step(c: str) -> str:
        return f"xor({c} >> 4, {steps}[({c} & 15) + 1])"

    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step(step('xor(c, b)'))}))"


def oracle() -> str:
    """variants() for DuckDB, by way of the strings that deleting one code point leaves."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE runs AS (
      SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
          '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
      WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
    hashed AS (SELECT run, n, {_crc32_sql("doc_id || ':' || run")} AS h FROM runs),
    spelt AS (
      SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
        ELSE run END AS word, n FROM hashed),
    words AS (
      SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= {LEAST_CHARS}
      GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    cut AS (
      SELECT DISTINCT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
      FROM words, unnest(range(length(word))) AS t(i)),
    near AS (
      SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
      UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = cut.rest
      UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = cut.rest),
    best AS (
      SELECT near.word, count(*) AS n_near, first(near.near ORDER BY w.n DESC, encode(near.near)) AS near, max(w.n) AS near_n
      FROM near JOIN words w ON w.word = near.near GROUP BY near.word),
    forms AS (
      SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * n THEN near END AS form,
        CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
    paths AS (
      SELECT word, word AS root, 0 AS steps FROM forms
      UNION ALL SELECT paths.word, forms.form, steps + 1 FROM paths JOIN forms ON forms.word = root WHERE form IS NOT NULL),
    ends AS (SELECT word, arg_max(root, steps) AS root FROM paths GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
