import numpy as np
import pytest

from palimpsest.llm import embdedup, vptree

VEC = "vec_id bigint, embedding array<float>, label int, rank int"


def table(rng, n=900, d=12):
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[100:140] = x[7]
    x[200:260] = x[8] + 0.02 * rng.standard_normal((60, d)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(0, 3)) if i % 50 else None, 0) for i in range(n)]
    rows += [(n, None, 1, 0), (n + 1, [0.0] * d, 1, 0), (n + 2, [float("nan")] * d, 1, 0), (n + 3, [None] * d, 1, 0), (n + 4, [], 1, 0), (None, [1.0] * d, 1, 0), (n + 5, [float("inf")] * d, 1, 0)]
    rows[202] = (*rows[202][:2], 1, 0)
    return rows, x


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (1.2, 0.9)])
def test_nearest(write, factor, least):
    rows, x = table(np.random.default_rng(1))
    df = write(rows, VEC)
    got = vptree.nearest(df, df.where("vec_id % 20 = 0"), 20, factor, shard_rows=300, block_rows=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 900, 20))
    x64, hits = x.astype(np.float64), 0
    for q, rs in by.items():
        rs.sort()
        s = (x64 * x64[q]).sum(1)
        ids = np.delete(np.arange(900), q)
        best = ids[np.lexsort((ids, -s[ids]))][:20]
        assert [k for k, *_ in rs] == list(range(1, 21))
        if factor == 1:
            assert [i for _, i, _ in rs] == list(best)
        assert all(abs(v - s[i]) < 1e-12 for _, i, v in rs)
        hits += len(set(best) & {i for _, i, _ in rs})
    assert hits >= least * 20 * len(by)


def test_nearest_edges(write):
    few = write([(0, [1.0, 0.0], 1, 0), (1, [0.5, 0.5], 1, 0), (2, [1.0, 1.0, 1.0], 1, 0), (1, [0.5, 0.5], 1, 0)], VEC)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.nearest(few, few.where("vec_id = 0")).collect()) == [(0, 1, 1, 0.5), (0, 2, 1, 0.5)]
    none = write([], VEC)
    assert vptree.nearest(none, none).count() == 0 and vptree.nearest(few, none).count() == 0


def test_near_vectors(write):
    rows, x = table(np.random.default_rng(2))
    rows += [(7, rows[7][1], rows[7][2], 0)]
    for block in (2048, 40):
        got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in embdedup.near_vectors(write(rows, VEC), block=block).collect())
        u = x.astype(np.float64)
        u /= np.sqrt((u * u).sum(1))[:, None]
        label = [r[2] for r in rows[:900]] + [rows[7][2]]
        u = np.concatenate([u, u[7:8]])
        ids = list(range(900)) + [7]
        link = (u @ u.T >= 0.98) & np.array([[a == b and a is not None for b in label] for a in label])
        np.fill_diagonal(link, False)
        comp = list(range(901))

        def find(i):
            while comp[i] != i:
                i = comp[i]
            return i

        comp[900] = 7
        for i, j in zip(*np.nonzero(link)):
            a, b = find(i), find(j)
            comp[max(a, b)] = min(a, b)
        want = [(ids[i], int(link[i].sum()), find(i), ids[i] == find(i)) for i in range(901)]
        want += [(i, 0, i, True) for i in range(900, 906)] + [(-1, 0, None, None)]
        assert got == sorted(want)
    assert embdedup.near_vectors(write([], VEC)).count() == 0


def test_tables():
    k, n = embdedup.plan_tables(1_000_000, 0.98, 1.5, 1e-6)
    near = embdedup.same_slot(0.2, 1.5)
    assert (1 - near**k) ** n <= 1e-6 and 5 < k < 20
