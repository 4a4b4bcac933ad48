"""Exact integer clusters against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from hitledger.llm import centroids


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    """rows: (id, vector). Cluster, distance, its cluster's sum, sum of all, centroid by plain loops over Python integers."""
    ok = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if ok(v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    points = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p)), n) for n, p in enumerate(points))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(points)):
            own = [v for (_, v), c in zip(kept, of) if c == n]
            if own:
                points[n] = [sum(col) // len(own) for col in zip(*own)]
    at = [near(v) for _, v in kept]
    part = {n: sum(d for d, c in at if c == n) for n in range(len(points))}
    total = sum(d for d, _ in at)
    return sorted(((i is None, i or 0), c, d, part[c], total, ",".join(map(str, points[c]))) for (i, _), (d, c) in zip(kept, at))


def run(spark, rows, **args):
    df = spark.createDataFrame([(i, v, "kept", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, `a.b` int").repartition(4)
    got = centroids.cluster(df, **args)
    assert got.columns == ["vec_id", "embedding", "a.b", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return sorted(((r[0] is None, r[0] or 0), *r[3:]) for r in got.collect())


def test_against_plain_loops(spark):
    r = random.Random(4)
    middle = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in middle[i % 5]]) for i in range(400)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None] + [0.0] * 63), (405, [math.nan] + [0.0] * 63), (406, [math.inf] + [0.0] * 63)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    assert run(spark, rows) == brute(rows)


def test_ties_and_repeats(spark):
    """Vectors of few whole steps: many equal distances, equal vectors and centroids that stay empty."""
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 1 / 64]) for _ in range(3)]) for i in range(150)]
    assert run(spark, rows, k=12, dims=3) == brute(rows, k=12, dims=3)
    few = rows[:5]
    assert run(spark, few, k=12, dims=3) == brute(few, k=12, dims=3)
    assert run(spark, rows[:0], k=12, dims=3) == []


def test_components_of_any_size(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([-1, 1]) * 10.0 ** r.randint(0, 150) for _ in range(2)]) for i in range(40)]
    want = [(*w[:2], *[x if x < 2**63 else None for x in w[2:5]], w[5]) for w in brute(rows, k=4, dims=2)]
    assert run(spark, rows, k=4, dims=2) == want


@pytest.mark.parametrize("dims,k", [(1, 16), (2, 9), (8, 40), (64, 16)])
def test_tree_finds_the_nearest(dims, k):
    g = np.random.default_rng(dims)
    for spread in (1, 3, 1000):
        points = g.integers(-spread, spread + 1, size=(k, dims))
        x = g.integers(-2 * spread, 2 * spread + 1, size=(500, dims))
        d = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
        number, far = centroids.Tree.of(points.tolist()).nearest(x)
        assert (number == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_tree_prunes():
    """Of centroids on a line, a vector opens a few, not all."""
    points = [[100 * i] for i in range(256)]
    tree = centroids.Tree.of(points)
    opened = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            opened.append(np.size(key))
            return np.asarray(self)[key]

    counted = centroids.Tree(tree.points.view(Counted), tree.number, tree.children)
    x = np.arange(0, 25_600, 40).reshape(-1, 1)
    number, _ = counted.nearest(x)
    assert (number == tree.nearest(x)[0]).all() and sum(opened) < 40 * len(x)
