"""Near-duplicate vectors by E8 lattice hashing in several tables, verified by cosine.

In each table a vector is projected to BLOCKS times 8 dimensions, each decoded to the nearest point
of the lattice E8; the points make the key of its cell. A vector stands in its own cell and asks
there and in neighbouring cells: per block, the PROBES lattice points next nearest to it. Two vectors
at the cosine meet in a table with a chance of about 0.98, so they miss each other in all tables
about once in 10^8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.base import row_numbers, written
from dialoom.llm.components import components
from dialoom.llm.hashing import ODD, mixed

COSINE = 0.98
TABLES, BLOCKS, PROBES = 5, 2, 4
SCALE = 1.5
KEYS = (1 + PROBES) ** BLOCKS
ROWS = 512


@lru_cache(1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring lattice points."""
    steps = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            step = [0.0] * 8
            step[i], step[j] = a, b
            steps.append(step)
    steps += [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(steps)


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum."""
    point = np.rint(y)
    off = y - point
    odd = np.flatnonzero(point.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: even whole points, or those moved by a half everywhere."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(8)
def _projections(size: int) -> np.ndarray:
    """(tables, blocks, size, 8) projections that keep the length of a unit vector on average."""
    made = np.random.default_rng([8, size])
    drawn = made.normal(size=(TABLES, BLOCKS, size, 8))
    if size < 8:
        return drawn / np.sqrt(8)
    return np.linalg.qr(drawn)[0] * np.sqrt(size / 8)


def _cell_hash(points: np.ndarray, seed: int) -> np.ndarray:
    out = np.full(len(points), seed, np.uint64)
    for column in (2 * points).astype(np.int64).astype(np.uint64).T:
        out = mixed(out * ODD + column)
    return out


def keys(unit: np.ndarray, label: int) -> np.ndarray:
    """(vectors, TABLES, KEYS) cell keys; the first of a table is the vector's own cell."""
    n, size = unit.shape
    out = np.empty((n, TABLES, KEYS), np.uint64)
    for t, table in enumerate(_projections(size)):
        combined = mixed(np.full((n, 1), (label * 64 + t) & 0xFFFFFFFFFFFF, np.uint64) * ODD + np.uint64(size))
        for b, matrix in enumerate(table):
            y = unit @ matrix * SCALE
            cell = decode(y)
            nearest = np.argsort(-((y - cell) @ roots().T), axis=1, kind="stable")[:, :PROBES]
            choice = [_cell_hash(cell, b)] + [
                _cell_hash(cell + roots()[nearest[:, p]], b) for p in range(PROBES)]
            combined = mixed(combined[:, :, None] * ODD + np.array(choice).T[:, None, :]).reshape(n, -1)
        out[:, t] = combined
    return out


def _usable(vector: list | None) -> bool:
    return bool(vector) and None not in vector and bool(np.isfinite(vector).all()) and any(vector)


def _unit(packed: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _packed(vectors: DataFrame) -> DataFrame:
    """(rid, vec_id, label, v): v holds the doubles of a vector that can be compared, else null."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = row_numbers()
        for batch in source:
            packed = [np.array(v, "<f8").tobytes() if label is not None and _usable(v) else None
                      for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(numbers) for _ in packed], pa.int64()), batch.column(0).cast(pa.int64()),
                 batch.column(2).cast(pa.int64()), pa.array(packed, pa.binary())],
                names=["rid", "vec_id", "label", "v"])

    return vectors.select("vec_id", "embedding", "label").mapInArrow(
        batches, "rid long, vec_id long, label long, v binary")


def _cells(classes: DataFrame) -> DataFrame:
    """(key, c, asks): the cell a vector stands in (asks = false), and those it asks in."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            c, label, v = (x.to_pylist() for x in batch.columns)
            groups: dict[tuple, list[int]] = {}
            for i in range(len(c)):
                groups.setdefault((label[i], len(v[i])), []).append(i)
            for (name, _), rows in groups.items():
                for at in range(0, len(rows), 2000):
                    some = rows[at:at + 2000]
                    found = keys(_unit([v[i] for i in some]), name).view(np.int64)
                    ids = np.array([c[i] for i in some], np.int64)
                    stands = found[:, :, 0].ravel()
                    asked = found.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([stands, asked])),
                         pa.array(np.concatenate([np.repeat(ids, TABLES), np.repeat(ids, TABLES * KEYS)])),
                         pa.array(np.repeat([False, True], [len(stands), len(asked)]))],
                        names=["key", "c", "asks"])

    return classes.select("c", "label", "v").mapInArrow(batches, "key long, c long, asks boolean")


def _first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a below b) with their keys: the one (key, whether a stands there) to count them at.

    That is the first table where they meet, and there the cell of a, if b asks in it.
    """
    in_a = (a[:, :, :1] == b).any(2)
    in_b = (b[:, :, :1] == a).any(2)
    table = (in_a | in_b).argmax(1)
    rows = np.arange(len(a))
    stands = in_a[rows, table]
    return np.where(stands, a[rows, table, 0], b[rows, table, 0]), stands


def _linked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare those who stand in a cell with those who ask there; rows sorted by cell and block.

    Out come, per block, each vector's number of copies linked (times its partner's weight) and a
    forest that connects the linked ones: as many rows as vectors, however many pairs link.
    """

    def compare(key: int, rows: list[tuple]) -> Iterator[tuple]:
        standing = [r for r in rows if not r[3]]
        asking = [r for r in rows if r[3]]
        for label, size in {(r[5], len(r[7])) for r in standing}:
            left = [r for r in standing if (r[5], len(r[7])) == (label, size)]
            right = [r for r in asking if (r[5], len(r[7])) == (label, size)]
            if not right:
                continue
            x, y = _unit([r[7] for r in left]), _unit([r[7] for r in right])
            i, j = np.nonzero(x @ y.T >= COSINE)
            li, rj = np.array([r[4] for r in left]), np.array([r[4] for r in right])
            other = li[i] != rj[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            used_x, i_of = np.unique(i, return_inverse=True)
            used_y, j_of = np.unique(j, return_inverse=True)
            kx, ky = keys(x[used_x], label), keys(y[used_y], label)
            counted = np.empty(len(i), bool)
            for at in range(0, len(i), 20_000):
                part = slice(at, at + 20_000)
                swap = li[i[part]] > rj[j[part]]
                own, ask = kx[i_of[part]], ky[j_of[part]]
                where, stands = _first_meeting(np.where(swap[:, None, None], ask, own),
                                               np.where(swap[:, None, None], own, ask))
                counted[part] = (where == np.uint64(key % (1 << 64))) & (stands != swap)
            wx, wy = np.array([r[6] for r in left]), np.array([r[6] for r in right])
            nx = np.bincount(i[counted], wy[j[counted]], len(left)).astype(np.int64)
            ny = np.bincount(j[counted], wx[i[counted]], len(right)).astype(np.int64)
            top_x, top_y = li.copy(), rj.copy()
            while True:  # least id along links, to a standstill
                before = top_x.sum() + top_y.sum()
                np.minimum.at(top_x, i, top_y[j])
                np.minimum.at(top_y, j, top_x[i])
                if before == top_x.sum() + top_y.sum():
                    break
            yield from zip(li.tolist(), nx.tolist(), top_x.tolist())
            yield from zip(rj.tolist(), ny.tolist(), top_y.tolist())

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in found], pa.int64()) for k in range(3)], names=["c", "links", "top"])

    group, rows = None, []
    for batch in source:
        found: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != group:
                if rows:
                    found += compare(group[0], rows)
                group, rows = row[:3], []
            rows.append(row)
        yield out(found)
    if rows:
        yield out(list(compare(group[0], rows)))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Vectors with equal labels and a cosine of at least COSINE, in doubles, are linked. A null label,
    and a vector that is null, empty, zero, or has null or non-finite components, or another length,
    links with nothing. Equal vectors of a label are one class with a weight, so copies cost no
    pairs. Repeated vec_ids are rows of their own; a null vec_id is never kept. Other columns are
    not read; an empty table gives no rows.
    """
    packed = written(_packed(vectors), "vectors")
    classes = packed.where("v IS NOT NULL").groupBy("label", "v").agg(
        F.min("rid").alias("c"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = written(classes, "classes")
    cells = written(_cells(classes), "cells")
    full = cells.groupBy("key").agg(
        F.count_if(~F.col("asks")).alias("stand"), F.count_if("asks").alias("ask"),
        F.min("c").alias("low"), F.max("c").alias("high")
    ).where("stand > 0 AND low < high").select(
        "key", F.ceil(F.col("stand") / ROWS).cast("int").alias("x_blocks"),
        F.ceil(F.col("ask") / ROWS).cast("int").alias("y_blocks"))
    place = F.xxhash64("c")
    own = F.pmod(place, F.when(F.col("asks"), F.col("y_blocks")).otherwise(F.col("x_blocks"))).cast("int")
    others = F.when(F.col("asks"), F.col("x_blocks")).otherwise(F.col("y_blocks"))
    blocks = (cells.join(full, "key")
              .select("key", "c", "asks", own.alias("own"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
              .select("key", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("x"),
                      F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("y"), "asks", "c")
              .join(classes.select("c", "label", "weight", "v"), "c")
              .select("key", "x", "y", "asks", "c", "label", "weight", "v"))
    found = written(blocks.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
                    .mapInArrow(_linked, "c long, links long, top long"), "links")
    parts = components(found.where("c <> top").select(F.col("c").alias("u"), F.col("top").alias("v")))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    joined = (classes.join(counts, "c", "left").join(parts, F.col("c") == F.col("u"), "left")
              .withColumn("part", F.coalesce("component", "c")))
    names = joined.groupBy("part").agg(F.min("least").alias("component_id"))
    by_class = joined.join(names, "part").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    return (packed.join(by_class, ["label", "v"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
                    .alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def oracle() -> str:
    """The same for DuckDB, by comparing all pairs of a label."""
    return f"""
    WITH RECURSIVE usable AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
    reach AS (
      SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
    least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
    counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(other, e.vec_id)) AS component_id,
      e.vec_id = least(e.vec_id, coalesce(other, e.vec_id)) AS kept
    FROM embeddings e LEFT JOIN counts USING (vec_id) LEFT JOIN least USING (vec_id)"""
