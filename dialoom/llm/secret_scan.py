"""Secrets by fixed patterns, and by character Markov models of random and ordinary strings.

The patterns always count. Any other long token is scored by two models with two characters of context, one of
random strings and one of ordinary identifiers, both trained from labelled samples; where the
log-likelihood ratio is high enough, the token is one more secret.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.base import per_row, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
#: Runs of access and hex characters are whole: a shorter start inside a run is never longer.
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_CHARS - 4},}}")
HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_CHARS},}}")
TOKEN_CHARS = 16
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}")
LETTER = re.compile("[A-Za-z]")
#: The keyword test before the assign pattern; each of its words holds one of these.
KEYWORD = re.compile("pass|secret|token|api", re.ASCII | re.IGNORECASE)

#: Labelled samples: at most this many strings of either label, lowest hashes first.
SAMPLE = 4000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-. "
ORDER = 2
LEAST_PER_CHAR = 0.35
MASK = "[secret]"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind."""
    spans = []
    if KEYWORD.search(text):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def secret_strings(text: str) -> Iterator[str]:
    """The secret parts of the base spans: labelled samples of random strings."""
    for kind, start, end in base_spans(text):
        yield ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def spelled(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered(spans))


def _codes(string: str) -> np.ndarray:
    """Character numbers, with blanks in front so that the first characters have a context."""
    raw = np.frombuffer((" " * ORDER + string).encode("ascii", "replace"), np.uint8)
    return _NUMBER[raw]


_NUMBER = np.full(256, len(ALPHABET) - 1, np.int64)
for _i, _c in enumerate(ALPHABET):
    _NUMBER[ord(_c)] = _i


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio of random against ordinary for each character after two others."""

    ratio: np.ndarray

    def score(self, string: str) -> float:
        """Log-likelihood ratio per character."""
        c = _codes(string)
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean()) if len(c) > ORDER else 0.0


def train(random: Iterable[str], ordinary: Iterable[str]) -> Models:
    """Two smoothed Markov models from labelled strings, kept as one table of log ratios.

    A context is backed off to the shorter one in proportion to how seldom it was seen. Without
    samples of a label its model is uniform, and with none at all every ratio is 0.
    """
    n = len(ALPHABET)

    def model(strings: Iterable[str]) -> np.ndarray:
        counts = np.zeros((n, n, n))
        for string in strings:
            c = _codes(string)
            np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
        single = (counts.sum((0, 1)) + 1) / (counts.sum() + n)
        pairs = counts.sum(0)
        double = (pairs + 8 * single) / (pairs.sum(1, keepdims=True) + 8)
        return (counts + 8 * double[None]) / (counts.sum(2, keepdims=True) + 8)

    return Models((np.log(model(random)) - np.log(model(ordinary))).astype(np.float32))


def _hash(string: str) -> int:
    return xxhash.xxh3_64_intdigest(string) >> 1


def labelled_samples(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(random, string): what the patterns find, and ordinary tokens, over all documents.

    The sample of a label is its distinct strings with the lowest hashes, `sample` at most; tasks
    already leave out what cannot be among them.
    """
    word = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_+/=-]{6,64}(?![A-Za-z0-9+/_=-])")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest: dict[bool, list[tuple[int, str]]] = {True: [], False: []}
        seen: dict[bool, set[str]] = {True: set(), False: set()}

        def prune() -> None:
            for label, strings in seen.items():
                hashed = {(_hash(s), s) for s in strings}
                lowest[label] = heapq.nsmallest(sample, hashed.union(lowest[label]))
                strings.clear()

        for batch in source:
            for text in batch.column(0).to_pylist():
                if text:
                    secrets = set(secret_strings(text))
                    seen[True] |= secrets
                    seen[False].update(set(word.findall(text)) - secrets)
                if len(seen[False]) + len(seen[True]) > 50 * sample:
                    prune()
        prune()
        rows = [(label, s, h) for label, own in lowest.items() for h, s in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int64())], names=["random", "string", "hash"])

    # both labels are read from it, so the texts are scanned once
    found = written(docs.select("text").mapInArrow(batches, "random boolean, string string, hash long").distinct(), "strings")
    kinds = [found.where("random").orderBy("hash", "string").limit(sample),
             found.where("NOT random").orderBy("hash", "string").limit(sample)]
    return kinds[0].unionByName(kinds[1]).select("random", "string")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Models:
    rows = labelled_samples(docs, sample).collect()  # at most 2 * sample strings
    strings = sorted((r.random, r.string) for r in rows)
    return train((s for random, s in strings if random), (s for random, s in strings if not random))


def model_spans(text: str, base: list[Span], models: Models) -> list[Span]:
    """Long tokens outside the base spans that look random rather than ordinary.

    A token without letters (a number, a date) is not taken for a secret.
    """
    taken, at = sorted((start, end) for _, start, end in base), 0
    spans, covered = [], 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][0] < end:  # base spans that begin before the token ends
            covered, at = max(covered, taken[at][1]), at + 1
        if covered <= start and LETTER.search(m.group()) and models.score(m.group()) >= LEAST_PER_CHAR:
            spans.append(("random", start, end))
    return spans


def masked(text: str, spans: list[Span]) -> str:
    """The text with each covered stretch replaced by MASK; of an assignment the name stays."""
    cuts = []
    for kind, start, end in spans:
        cuts.append((ASSIGN.match(text, start).start(2) if kind == "assign" else start, end))
    out, at = [], 0
    for start, end in sorted(cuts):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row of docs.

    Null and empty texts have no spans; repeated rows are scanned each; a null doc_id is kept;
    other columns are not read; an empty table gives no rows.
    """
    models = models or fit(docs)

    def row(_: None, doc_id: int | None, text: str | None) -> tuple:
        text = text or ""
        base = base_spans(text)
        more = model_spans(text, base, models)
        count = {kind: sum(s[0] == kind for s in base + more) for kind in KINDS}
        return (doc_id, count["assign"], count["access"], count["hex"],
                hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + more), count["random"])

    return per_row(docs, ["doc_id", "text"], row,
                   "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                   "spans string, n_random long")


def redacted(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """docs with secrets masked in `text` and n_chars counted anew; all columns and rows stay.

    Null texts stay null. Only texts with a secret change.
    """
    models = models or fit(docs)
    at = docs.columns.index("text")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    if spans := base + model_spans(text, base, models):
                        texts[i] = masked(text, spans)
            columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(batches, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(
        docs.schema["n_chars"].dataType))
