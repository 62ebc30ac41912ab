"""Dual-tree Lloyd against comparing every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest

from palimpsest.llm import kmeans

ROW = "vec_id bigint, embedding array<float>"


def plain_lloyd(rows, k, rounds, dims, seed=3):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(col) // len(g) for col in zip(*g)] if (g := [v for (_, v), o in zip(kept, own) if o == j]) else c[j] for j in range(len(c))]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def clusters(rng, n, dims, groups=6, spread=0.02):
    centre = rng.normal(size=(groups, dims))
    return (centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def test_cover_tree_covers_and_parts():
    rng = np.random.default_rng(2)
    x = np.concatenate([clusters(rng, 700, 5), clusters(rng, 1, 5).repeat(60, 0)])
    t = kmeans.CoverTree(x, 4)
    assert sorted(t.order) == list(range(len(x)))
    y = x[t.order].astype(float)
    for c, r, (b, e), (f, g) in zip(t.centre, t.radius, t.span, t.kids):
        assert b <= c < e and np.linalg.norm(y[b:e] - y[c], axis=1).max() <= r + 1e-6
        if g:
            assert t.span[f, 0] == b and t.span[g - 1, 1] == e and (t.span[f + 1 : g, 0] == t.span[f : g - 1, 1]).all()
            own = y[t.centre[f:g]]
            gaps = np.linalg.norm(own[:, None] - own[None], axis=2)[~np.eye(g - f, dtype=bool)]
            assert gaps.min() > r / 2 - 1e-6


@pytest.mark.parametrize("n,k,dims,spread", [(500, 8, 64, 0.02), (300, 40, 3, 0.3), (50, 5, 2, 0.0), (1, 1, 4, 0.1)])
def test_labels_equal_all_pairs(n, k, dims, spread):
    rng = np.random.default_rng(n)
    x = np.floor(64 * clusters(rng, n, dims, spread=spread)).astype(np.int64)
    c = x[rng.integers(0, n, k)] + rng.integers(-1, 2, (k, dims))
    c[-1] = c[0]  # a tie for every vector near it
    t = kmeans.CoverTree(x, 4)
    d = ((x[t.order][:, None] - c[None]) ** 2).sum(2)
    assert (kmeans.labels(t, x[t.order], c) == d.argmin(1)).all()


def test_node_pairs_are_pruned():
    x = np.floor(1024 * clusters(np.random.default_rng(5), 4000, 64, groups=8)).astype(np.int64)
    t = kmeans.CoverTree(x)
    x = x[t.order]
    c = x[np.unique((x[:, 0] // 50), return_index=True)[1]][:8]
    whole, points, _, compared = kmeans.nearest_centroids(t, x, c)
    assert sum(e - b for b, e, _ in whole) + len(points) == len(x)
    assert compared < len(x) * len(c) / 2


def test_cluster_against_a_plain_version(spark):
    rng = np.random.default_rng(7)
    x = clusters(rng, 400, 4, groups=3, spread=0.3).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(5, x[5])] * 30 + [(5, x[6]), (None, x[7]), (None, None), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4), (905, [0.0] * 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], ROW + ", cluster string").repartition(5)
    for k, rounds in ((8, 10), (3, 1), (30, 4)):
        got, c = kmeans.cluster(df, k=k, rounds=rounds, dims=4, shard_rows=100)
        want, cw = plain_lloyd(rows, k, rounds, 4)
        key = lambda r: tuple((v is None, v) for v in r)
        assert c.tolist() == cw
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    full = kmeans.with_inertia(*kmeans.cluster(df, k=3, rounds=2, dims=4)).collect()
    assert {r.inertia for r in full} == {sum(r.distance for r in full)}
    assert all(r.cluster_inertia == sum(q.distance for q in full if q.cluster == r.cluster) for r in full)


def test_few_or_no_vectors(spark):
    empty, c = kmeans.cluster(spark.createDataFrame([], ROW), dims=2)
    assert empty.count() == 0 and len(c) == 0 and kmeans.with_inertia(empty, c).count() == 0
    got, c = kmeans.cluster(spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.25, 1e30])], ROW), dims=2)
    assert c.tolist() == [[512, -512]] and [tuple(r) for r in got.collect()] == [(1, 0, 0)]
