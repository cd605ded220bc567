"""Removal of repeated 50-byte strings, by bucket-pointer refinement of suffixes.

Suffixes that start with the same q bytes share a bucket. A bucket's identifier is made from
identifiers of shorter ones at later offsets: 8 bytes, then 16 from (8 at p, 8 at p + 8), 24, 32, 48,
and 50 as the last. Each is computed once per place and used again by all longer ones. Identifiers
depend on the bytes alone, so buckets of all documents are comparable without a global sort.

Only buckets that more than one document shares are refined further, and not every place is dealt
out. Each 50-byte string is led by its least 24-byte bucket, its anchor; neighbouring strings with
one anchor make a run. Runs are sorted by (anchor, run): equal runs settle all their strings at once,
an anchor with one run is done, and only where an anchor has several runs (the ends of repeats) are
the 50-byte buckets themselves compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoom.llm.base import written
from dialoom.llm.hashing import ODD, mixed

LENGTH = 50
ANCHOR = 24
WINDOW = LENGTH - ANCHOR + 1
#: Places of a piece of a long document; a place must fit the low bits of an anchor's rank.
PLACE_BITS = 20
PIECE = 1 << 19
HELD = 1000


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * ODD + b)


@dataclass(frozen=True)
class Runs:
    """Runs of a piece: strings starts[i] to starts[i + 1] - 1 share an anchor."""

    strings: np.ndarray
    starts: np.ndarray
    anchors: np.ndarray
    names: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.strings))


def runs(raw: np.ndarray) -> Runs | None:
    """The runs of a piece of text, and the bucket of each of its 50-byte strings."""
    n = len(raw) - LENGTH + 1
    if n < 1:
        return None
    ids = raw.astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes fill an identifier exactly
        ids = (ids[:-step] << np.uint64(8 * step)) | ids[step:]
    b16 = _pair(ids[:-8], ids[8:])
    b24 = _pair(b16[:-8], ids[16:])
    b32 = _pair(b16[:-16], b16[16:])
    b48 = _pair(b32[:-16], b16[32:])
    strings = _pair(b48[:n], b16[34:34 + n])
    low = np.uint64(PLACE_BITS)
    rank = (b24 >> low << low) | np.arange(len(b24), dtype=np.uint64)  # equal buckets: leftmost first
    for step in (1, 2, 4, 8):
        rank = np.minimum(rank[:-step], rank[step:])
    rank = np.minimum(rank[:n], rank[WINDOW - 16:WINDOW - 16 + n])
    starts = np.concatenate([[0], np.flatnonzero(rank[1:] != rank[:-1]) + 1])
    ends = np.concatenate([starts[1:], [n]])
    names = _pair(strings[starts], strings[ends - 1]) + (ends - starts).astype(np.uint64)
    return Runs(strings, starts, (rank[starts] >> low).view(np.int64), names.view(np.int64))


def pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) so that every 50-byte string lies in exactly one piece as a start."""
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
        yield at, raw[at:at + PIECE + LENGTH - 1]


def _dealt(docs: DataFrame) -> DataFrame:
    """(anchor, run, doc): the distinct runs of every document."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made, rows = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for _, raw in pieces(memoryview(text.as_buffer()) if text.is_valid else b""):
                    found = runs(raw)
                    names, first = np.unique(found.names, return_index=True)
                    made.append((found.anchors[first], names, np.full(len(names), doc, np.int64)))
                    rows += len(names)
                    if rows > 500_000:
                        yield _columns(made, ("anchor", "run", "doc"))
                        made, rows = [], 0
            if made:
                yield _columns(made, ("anchor", "run", "doc"))

    return (docs.where("doc_id IS NOT NULL").select("doc_id", F.encode("text", "UTF-8"))
            .mapInArrow(batches, "anchor long, run long, doc long"))


def _columns(made: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=list(names))


def _shared(dealt: DataFrame) -> DataFrame:
    """(doc, run, settled) from runs sorted by (anchor, run, doc), whatever the size of a bucket.

    settled: a smaller document has the equal run, so all its strings go. Otherwise the document is
    the first with this run, and its strings are to be compared with those of the anchor's others.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = run = first = least = None
        others, n_runs = False, 0
        held: list[tuple[int, int, bool]] = []  # first of each run, until its anchor proves shared
        for batch in source:
            columns = [c.to_numpy() for c in batch.columns]
            a = columns[0]
            alone = np.zeros(len(a), bool)  # anchors that occur once, away from the batch's ends
            alone[1:-1] = (a[1:-1] != a[:-2]) & (a[1:-1] != a[2:])
            out: list[tuple[int, int, bool]] = []
            for x, r, d in zip(*(c[~alone].tolist() for c in columns)):
                if x != anchor:
                    anchor, run, first, least = x, r, d, d
                    others, n_runs, held = False, 1, [(d, r, False)]
                    continue
                others = others or d != first
                if r != run:
                    run, least, n_runs = r, d, n_runs + 1
                    held.append((d, r, False))
                elif d > least:
                    out.append((d, r, True))
                if held and n_runs > 1 and (others or len(held) > HELD):
                    out += held
                    held = []
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.bool_())], names=["doc", "run", "settled"])

    return (dealt.repartition("anchor").sortWithinPartitions("anchor", "run", "doc")
            .mapInArrow(batches, "doc long, run long, settled boolean"))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts, compressed for the shuffle."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in source:
            packed = [press.compress(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(packed, pa.binary())],
                                             names=["doc_id", "packed"])

    return docs.select("doc_id", F.encode("text", "UTF-8")).mapInArrow(batches, "doc_id long, packed binary")


def _strings(marked: DataFrame) -> DataFrame:
    """(string, doc): the 50-byte buckets of the given runs of each text."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in source:
            made = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for doc, packed, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for _, raw in pieces(unpress.decompress(packed)):
                    found = runs(raw)
                    chosen = np.repeat(np.isin(found.names, wanted), found.lengths())
                    strings = np.unique(found.strings[chosen]).view(np.int64)
                    made.append((strings, np.full(len(strings), doc, np.int64)))
            yield _columns(made, ("string", "doc"))

    return marked.select("doc_id", "packed", "runs").mapInArrow(batches, "string long, doc long")


def _removed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text, what is left once the strings of settled runs and the doomed strings are taken out."""
    unpress = zstandard.ZstdDecompressor()
    for batch in source:
        rows = []
        for doc, packed, settled, doomed in zip(*(c.to_pylist() for c in batch.columns)):
            text = unpress.decompress(packed)
            n_removed = n_spans = 0
            if settled or doomed:
                edges = np.zeros(len(text) + 1, np.int32)
                for at, raw in pieces(text):
                    found = runs(raw)
                    gone = np.repeat(np.isin(found.names, settled or []), found.lengths())
                    gone |= np.isin(found.strings.view(np.int64), doomed or [])
                    starts = np.flatnonzero(gone) + at
                    edges[starts] += 1
                    edges[starts + LENGTH] -= 1
                covered = np.cumsum(edges[:-1]) > 0
                n_removed = int(covered.sum())
                n_spans = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
            else:
                kept = text
            rows.append((doc, len(text), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs.

    A byte goes when a 50-byte string over it also starts in a document with a smaller doc_id. Null
    texts are empty. Rows with one doc_id are one document to others, and each gets its result. A null
    doc_id is no smaller and no larger than any: its row loses nothing and removes nothing. Other
    columns are not read; an empty table gives no rows.
    """
    shared = written(_shared(_dealt(docs)), "shared")
    texts = _texts(docs)
    open_runs = shared.where("NOT settled").groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_set("run").alias("runs"))  # no more than a document has
    first = Window.partitionBy("string")
    doomed = (_strings(texts.join(open_runs, "doc_id"))
              .withColumn("least", F.min("doc").over(first)).where("doc > least")
              .groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("string").alias("doomed")))
    settled = shared.where("settled").groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_set("run").alias("settled"))
    return (texts.join(settled, "doc_id", "left").join(doomed, "doc_id", "left")
            .select("doc_id", "packed", "settled", "doomed")
            .mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                  "kept_sha256 string, kept binary"))


def oracle() -> str:
    """The same for DuckDB, from every 50-byte window of every document."""
    return f"""
    WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
    windows AS (
      SELECT doc_id, unnest(range(0, octet_length(t) - {LENGTH - 1})) AS i,
        unnest(list_transform(range(0, octet_length(t) - {LENGTH - 1}), lambda x: t[x + 1:x + {LENGTH}])) AS s
      FROM bytes),
    owners AS (SELECT s, min(doc_id) AS owner FROM windows GROUP BY s),
    gone AS (SELECT w.doc_id, w.i FROM windows w JOIN owners o USING (s) WHERE o.owner < w.doc_id),
    marked AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM gone),
    grouped AS (
      SELECT doc_id, i, count_if(step IS NULL OR step > {LENGTH}) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
    spans AS (SELECT doc_id, g, min(i) AS start, max(i) + {LENGTH} AS stop FROM grouped GROUP BY doc_id, g),
    between_spans AS (
      SELECT doc_id, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS low, start AS high FROM spans
      UNION ALL SELECT s.doc_id, max(stop), any_value(octet_length(t)) FROM spans s JOIN bytes USING (doc_id) GROUP BY s.doc_id),
    kept AS (
      SELECT k.doc_id, string_agg(hex(t[low + 1:high]), '' ORDER BY low) AS rest
      FROM between_spans k JOIN bytes USING (doc_id) GROUP BY k.doc_id),
    totals AS (SELECT doc_id, sum(stop - start)::BIGINT AS n, count(*) AS k FROM spans GROUP BY doc_id)
    SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed,
      coalesce(k, 0)::BIGINT AS n_spans, CASE WHEN rest IS NULL THEN sha256(t) ELSE sha256(unhex(rest)) END AS kept_sha256
    FROM bytes LEFT JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)"""
