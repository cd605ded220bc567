"""Vector near-duplicates against brute force; lattice decoding against search."""

import numpy as np
import pytest

from dialoom.llm import lattice_dedup as lattice

from .test_near_dedup import merged

SCHEMA = "vec_id long, embedding array<float>, label int, c long, v string"


def brute(rows):
    good = {}
    for i, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and any(v):
            good[i] = (np.array(v, np.float32).astype(float), label)
    links = []
    ids = sorted(good)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            (x, la), (y, lb) = good[a], good[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((a, b))
    tops = merged(links)
    return sorted((i, sum(i in p for p in links), tops.get(i, i), tops.get(i, i) == i) for i, *_ in rows)


def groups(made, sizes, noise):
    out = []
    for size in sizes:
        base = made.normal(size=64)
        out += [(base + made.normal(size=64) * noise * np.linalg.norm(base) / 8).tolist() for _ in range(size)]
    return out


def test_roots_and_decoding():
    assert lattice.roots().shape == (240, 8)
    y = np.random.default_rng(1).normal(size=(300, 8)) * 2
    cell = lattice.decode(y)
    assert np.allclose((2 * cell) % 1, 0) and np.allclose(cell.sum(1) % 2, 0)
    nearest = ((y - cell) ** 2).sum(1)
    for step in lattice.roots():
        assert (nearest <= ((y - cell - step) ** 2).sum(1) + 1e-9).all()


def test_against_brute_force(spark, monkeypatch):
    made = np.random.default_rng(2)
    vectors = groups(made, [1] * 40 + [2] * 20 + [30, 60], 0.13) + groups(made, [50], 0.05)
    rows = [(i, v, 1 if i % 7 else 2) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, vectors[0], None), (n + 3, [float("nan")] * 64, 1),
             (n + 4, [None] * 64, 1), (n + 5, [], 1), (n + 6, vectors[3], 1), (n + 7, vectors[3], 1),
             (n + 8, [1.0, 2.0], 1), (n + 9, [2.0, 4.0], 1), (n + 10, [float("inf")] * 64, 1)]
    frame = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], SCHEMA)
    want = brute(rows)
    assert sorted(map(tuple, lattice.near_duplicates(frame).collect())) == want
    monkeypatch.setattr(lattice, "ROWS", 4)  # many blocks per cell
    assert sorted(map(tuple, lattice.near_duplicates(frame).collect())) == want


def test_repeated_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)],
                                  "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, lattice.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False)], key=str)
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("cosine", [0.98, 0.985])
def test_recall_at_the_threshold(cosine):
    made = np.random.default_rng(3)
    x = made.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = made.normal(size=(3000, 64))
    g -= (g * x).sum(1)[:, None] * x
    g /= np.linalg.norm(g, axis=1)[:, None]
    y = cosine * x + np.sqrt(1 - cosine ** 2) * g
    a, b = lattice.keys(x, 1), lattice.keys(y, 1)
    met = ((a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2)))
    assert met.mean() >= 0.999
