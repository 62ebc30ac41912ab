import random
import zlib
from collections import Counter, defaultdict

from palimpsest.llm import mixing, sharding
from palimpsest.llm.common import connected_components, distributed_rank
from pyspark.sql import functions as F
from tests.llm.conftest import DOC


def test_shards(write):
    rows = [(i, "t" * (i % 9) if i % 7 else None) for i in range(1500)] + [(5, "same")] * 300 + [(None, "x"), (None, None)]
    df = write(rows, DOC)
    got = sharding.shard_documents(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    moved = sum(r.grown_shard == 8 for r in got if r.doc_id != 5) / 1500
    assert 0.07 < moved < 0.16
    assert sharding.shard_documents(write([], DOC)).count() == 0


def test_weights(spark):
    ids = spark.range(20000)
    n = Counter(r.s for r in ids.select(sharding.rendezvous_shard(F.col("id"), [1, 3, 0]).alias("s")).collect())
    assert n[2] == 0 and 2.7 < n[1] / n[0] < 3.3
    a = ids.select(sharding.rendezvous_shard(F.col("id"), [1, 1, 1]).alias("a"), sharding.rendezvous_shard(F.col("id"), [1, 2, 1]).alias("b")).collect()
    assert all(r.b in (r.a, 1) for r in a)


def targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left, sum_w = total - sum(fixed.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / sum_w > cap * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / sum_w for s in open_}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix(write):
    rng = random.Random(4)
    sources = ["big"] * 30 + ["b", "a", "é", None, "c", "empty"]
    rows = [(i, "w " * rng.randrange(40) if s != "empty" else " ", s, "x") for i in range(3000) for s in [rng.choice(sources)]] + [(7, "one two", "b", "y")] * 50 + [(None, None, "a", "z")]
    got = mixing.mix_documents(write(rows, "doc_id bigint, text string, source string, target string"), keep=["target"]).collect()
    assert len(got) == len(rows)
    size, taken, source_size = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        source_size[r.source] = (r.source_size, r.target)
        assert r.taken <= 3 * r.size and 0 <= r.copies <= 3
    want = targets(size)
    for s, (n, t) in source_size.items():
        assert n == size[s] and abs(t - want[s]) < 1e-6 * max(1, want[s]), s
        assert abs(taken[s] - t) <= 45, (s, taken[s], t)
    assert abs(sum(t for _, t in source_size.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    again = mixing.mix_documents(write(rows, "doc_id bigint, text string, source string, target string", 5)).collect()
    assert Counter((r.doc_id, r.size, r.source, r.copies) for r in got) == Counter((r.doc_id, r.size, r.source, r.copies) for r in again)
    assert mixing.mix_documents(write([], "doc_id bigint, text string, source string")).count() == 0


def test_rank(write):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", None, "n", "x"]), rng.randrange(50)) for _ in range(2000)]
    got = distributed_rank(write(rows, "p string, o int"), F.col("p"), [F.col("o")]).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.p].append((r["rank"], r.o))
    for s in by.values():
        assert [k for k, _ in s] == list(range(len(s))) and [o for _, o in s] == sorted(o for _, o in s)


def test_components(write):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(write(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(write([], "a bigint, b bigint")).count() == 0
