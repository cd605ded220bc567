"""Toxicity by a weighted lexicon, matched after folding look-alike characters.

The lexicon, its exception phrases and the scale of the score are all learned from labelled
documents. Matching is one Aho-Corasick pass over the folded text of a document.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, log1p

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.base import per_row, written

#: Labelled documents to learn from: at most this many of each label, lowest hashes first.
SAMPLE = 10_000
#: The lexicon holds whole words, and stems (beginnings of words) of these lengths.
STEMS = range(4, 9)
LEAST_WEIGHT = 2.5
SURENESS = 1.64
EXCEPTION_TIMES = 3
THRESHOLD = 0.3
USUAL_WORDS = 50
COUNTED = 500_000

# Characters that look like Latin letters, and digits and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
    "|": "i", "€": "e", "£": "l"}


@lru_cache(1)
def _table() -> dict[int, str]:
    """One character for each: accents go, compatible forms become plain, look-alikes Latin."""
    table = {ord(a): b for a, b in LOOK_ALIKES.items()}
    for span in ((0x80, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F), (0x1D400, 0x1D7FF)):
        for c in range(*span):
            plain = unicodedata.normalize("NFKD", chr(c)).lower()[:1]
            if c not in table and plain != chr(c) and plain.isascii() and plain.isalnum():
                table[c] = LOOK_ALIKES.get(plain, plain) if plain.isdigit() else plain
    return table


def fold(text: str) -> str:
    """Lower case with look-alikes folded; a combining accent goes with the letter before it."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.lower().translate(_table())


WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Lexicon:
    """Weights of entries, phrases in which they do not count, and the scale of the score.

    An entry that ends in a blank is a whole word, any other the beginning of a word.
    """

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    slope: float
    bias: float


class Matcher:
    """The lexicon as an automaton; made once per task."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights:
            string = entry.rstrip(" ")
            self.automaton.add_word(string, (string, weight, entry != string))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (phrase, None, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(start, string, weight) of words and stems outside of exception phrases."""
        if not len(self.automaton):
            return []
        spared, found = [], []
        for last, (string, weight, whole) in self.automaton.iter(folded):
            start, end = last - len(string) + 1, last + 1
            if (start and folded[start - 1].isalpha()) or (whole and folded[end:end + 1].isalpha()):
                continue
            if weight is None:
                spared.append((start, end))
            else:
                found.append((start, string, weight))
        if spared:
            found = [h for h in found if not any(a <= h[0] and h[0] + len(h[1]) <= b for a, b in spared)]
        return found

    def density(self, text: str | None) -> tuple[float, int]:
        """Weight per hundred words, damped, and the number of hits."""
        folded = fold(text or "")
        hits = self.hits(folded)
        if not hits:
            return 0.0, 0
        total = sum(w for *_, w in hits)
        return log1p(100 * total / (len(WORD.findall(folded)) + USUAL_WORDS)), len(hits)

    def score(self, density: float) -> float:
        return 1 / (1 + exp(-max(min(self.lexicon.slope * density + self.lexicon.bias, 30), -30)))


@lru_cache(2)
def _matcher(lexicon: Lexicon) -> Matcher:
    return Matcher(lexicon)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic): distinct labelled documents outside the held-out fold, at most 2 * sample.

    Their ids are bounded in number, so they go to the documents and no text is shuffled.
    """
    own = (labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id")
           .agg(F.max("toxic").alias("toxic")).withColumn("_hash", F.xxhash64("doc_id")))
    ids = [own.where(F.col("toxic") == t).orderBy("_hash", "doc_id").limit(sample).drop("_hash")
           for t in (0, 1)]
    picked = ids[0].unionByName(ids[1])
    return written(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
                   .where("text IS NOT NULL").select("text", "toxic"), "labelled")


def _counted(samples: DataFrame, strings) -> DataFrame:
    """(string, bad, good): in how many toxic and other texts each of strings(text) is."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(bad | good)
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in (bad, good)]],
                names=["string", "bad", "good"])

        for batch in source:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                (bad if toxic else good).update(strings(fold(text)))
                if len(bad) + len(good) > COUNTED:
                    yield out()
                    bad.clear()
                    good.clear()
        yield out()

    flagged = samples.dropDuplicates(["text"]).select("text", F.col("toxic").cast("int").alias("toxic"))
    return (flagged.mapInArrow(batches, "string string, bad long, good long").groupBy("string")
            .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))


def entries(folded: str) -> set[str]:
    """What a text may add to the lexicon: its words, and the stems of each."""
    found = set()
    for word in set(WORD.findall(folded)):
        found.add(word + " ")
        found.update(word[:n] for n in STEMS if n <= len(word))
    return found


def chosen(ranked: list[tuple[str, float]]) -> dict[str, float]:
    """Entries in their order, without those that begin, or are begun by, one before them."""
    kept: dict[str, float] = {}
    begun: set[str] = set()
    for entry, weight in ranked:
        starts = [entry[:n] for n in range(1, len(entry) + 1)]
        if entry in begun or any(s in kept for s in starts):
            continue
        kept[entry] = weight
        begun.update(starts)
    return kept


def _scale(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and bias of a ridge logistic regression on one number, by Newton steps."""
    slope, bias, ridge = 1.0, -2.0, 0.05
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in points:
            p = 1 / (1 + exp(-max(min(slope * x + bias, 30), -30)))
            v = p * (1 - p)
            g0, g1 = g0 + p - y, g1 + (p - y) * x
            h00, h01, h11 = h00 + v, h01 + v * x, h11 + v * x * x
        g0, g1, h00, h11 = g0 + ridge * (bias + 2), g1 + ridge * slope, h00 + ridge, h11 + ridge
        det = h00 * h11 - h01 * h01
        step0, step1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        bias, slope = bias - max(min(step0, 2), -2), slope - max(min(step1, 2), -2)
        if abs(step0) + abs(step1) < 1e-9:
            break
    return max(slope, 0.0), bias


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """The lexicon of the labelled documents; no labels give an empty one with a low score."""
    samples = labelled(docs, labels, sample)
    totals = {r.toxic: r.n for r in samples.dropDuplicates(["text"]).groupBy("toxic").agg(
        F.count("*").alias("n")).collect()}
    all_bad, all_good = totals.get(1, 0), totals.get(0, 0)
    counts = _counted(samples, entries)
    # what follows comes from the sampled labelled texts alone, so it does not grow with the documents
    # log-odds of a word, less SURENESS standard errors: what it is worth at least
    surely = (F.log((F.col("bad") + 0.5) / (all_bad + 1)) - F.log((F.col("good") + 0.5) / (all_good + 1))
              - SURENESS * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5)))
    top = (counts.withColumn("weight", F.round(surely, 6)).where(F.col("weight") >= LEAST_WEIGHT)
           .orderBy(F.desc("weight"), F.desc(F.length("string")), "string").collect())
    weights = chosen([(r.string, r.weight) for r in top])
    plain = Lexicon(tuple(weights.items()), (), 1.0, 0.0)

    def phrases(folded: str) -> set[str]:
        """Words with a hit, together with the word before and the word after."""
        found, hits = set(), {start for start, *_ in _matcher(plain).hits(folded)}
        words = list(WORD.finditer(folded)) if hits else []
        for a, b in zip(words, words[1:]):
            if (a.start() in hits or b.start() in hits) and b.start() - a.end() == 1:
                found.add(folded[a.start():b.end()])
        return found

    spared = []
    if weights:
        spared = [r.string for r in _counted(samples, phrases).where(
            (F.col("good") >= EXCEPTION_TIMES) & (F.col("good") * (all_bad + 1) > F.col("bad") * (all_good + 1) * 2)
        ).orderBy(F.desc("good"), "string").collect()]
    rough = Lexicon(tuple(sorted(weights.items())), tuple(sorted(spared)), 1.0, -2.0)
    densities = per_row(samples, ["text", "toxic"], lambda m, text, toxic: (round(m.density(text)[0], 2), int(toxic)),
                        "x double, y int", lambda: Matcher(rough))
    points = [(r.x, r.y) for r in densities.collect()]  # at most 2 * sample pairs of numbers
    slope, bias = _scale(sorted(points))
    return Lexicon(rough.weights, rough.exceptions, slope, bias)


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) for every row of docs.

    Only the text makes the score. Null and empty texts get the score of a text without hits.
    Repeated rows are scored each; a null doc_id is kept and not held out; other columns are not
    read; an empty table gives no rows.
    """
    def row(matcher: Matcher, doc_id: int | None, text: str | None) -> tuple:
        density, n_hits = matcher.density(text)
        score = matcher.score(density)
        return doc_id, score, int(score >= THRESHOLD), n_hits

    scored = per_row(docs, ["doc_id", "text"], row,
                     "doc_id long, score double, predicted int, n_hits long", lambda: Matcher(lexicon))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_hits")
