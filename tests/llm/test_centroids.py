"""Exponion search against Lloyd's rounds by all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from palimpsest.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance long, v string"


def brute(rows, k, rounds, width):
    kept = [
        (i, tuple(math.floor(1024 * x) for x in e))
        for i, e in rows
        if e is not None and len(e) == width and all(x is not None and math.isfinite(x) and abs(x * 1024) < 1 << 27 for x in e)
    ]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    at = [r[1] for r in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for _ in range(rounds):
        own = [min(range(len(at)), key=lambda c: (far(v, at[c]), c)) for _, v in kept]
        for c in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                at[c] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    near = [min((far(v, c), n) for n, c in enumerate(at)) for _, v in kept]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, near, strict=True)), key=repr), at


def vectors(seed, n, width, grid):
    rnd = random.Random(seed)
    value = (lambda: rnd.randint(-2, 2) / 1024) if grid else (lambda: rnd.gauss(0, 1))
    out = [(i, [value() for _ in range(width)]) for i in range(n)]
    bad = [(900, None), (901, []), (902, [1.0] * (width + 1)), (903, [float("nan")] + [0.0] * (width - 1)), (904, [float("inf")] * width), (905, [None] * width), (906, [1e300] * width)]
    return [*out, *bad, out[0], out[0], (None, [value() for _ in range(width)]), (None, None)]


@pytest.mark.parametrize("seed, n, width, k, rounds, grid", [(1, 300, 64, 8, 10, False), (2, 300, 3, 8, 10, True), (3, 120, 2, 5, 4, True), (4, 3, 4, 8, 3, False), (5, 40, 2, 1, 2, True)])
def test_equals_all_distances(spark, seed, n, width, k, rounds, grid):
    rows = vectors(seed, n, width, grid)
    df = spark.createDataFrame([(*r, 5, 6, "clash") for r in rows], SCHEMA)
    found, at = centroids.cluster(df, k, rounds, width)
    want, final = brute(rows, k, rounds, width)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=repr) == want
    assert [tuple(c) for c in at.tolist()] == final


def test_inertia_and_empty_table(spark):
    rows = vectors(7, 50, 4, False)
    found = centroids.with_inertia(*centroids.cluster(spark.createDataFrame([(*r, 5, 6, "") for r in rows], SCHEMA), 3, 4, 4)).collect()
    assert {r.inertia for r in found} == {sum(r.distance for r in found)}
    for c in {r.cluster for r in found}:
        assert {r.cluster_inertia for r in found if r.cluster == c} == {sum(r.distance for r in found if r.cluster == c)}
    empty = centroids.with_inertia(*centroids.cluster(spark.createDataFrame([], SCHEMA)))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_spare_distances_and_keep_ties():
    """Random moves of centroids: the search agrees with all distances, ties included, and scans only part of them."""
    rnd = np.random.default_rng(3)
    seen = total = 0
    for grid in (2, 200):
        v = rnd.integers(-grid, grid + 1, (400, 2))
        v[:200] += 900
        at = np.r_[v[:6], v[200:206]].astype(np.int64)
        a, upper, lower = np.full(400, -1), np.zeros(400), np.zeros(400)
        moved = np.zeros(12)
        for turn in range(12):
            a, upper, lower, scanned = centroids.search(v, a, upper, lower, centroids.Centroids(at, moved))
            far = ((v[:, None, :] - at[None]) ** 2).sum(2)
            assert (a == far.argmin(1)).all()
            assert (upper + 1e-6 >= np.sqrt(far.min(1))).all()
            if turn:
                seen, total = seen + scanned.sum(), total + 12 * len(v)
            new = at + rnd.integers(-1, 2, at.shape)
            at, moved = new, np.sqrt(((new - at) ** 2).sum(1))
    assert seen < 0.6 * total
