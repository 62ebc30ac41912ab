"""Blocked comparison of vectors against plain loops."""

import math
import random

from pyspark.sql import functions as F

from palimpsest.operators import dedup, near
from tests.test_engine import NOW, facts


def cosine_far(a, b):
    dot, size = sum(x * y for x, y in zip(a, b)), math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return 1 - dot / size if size and len(a) == len(b) else 1.0


def vectors(rng, n):
    made = [[float(rng.choice([-1, 0, 1, 2])) for _ in range(rng.choice([4, 4, 4, 5]))] for _ in range(n)]
    return [v if any(v) else [1.0] * 4 for v in made]


def test_nearest_in_blocks(spark):
    rng = random.Random(3)
    a, b = ([(rng.choice("st"), f"{side}{i}", v) for i, v in enumerate(vectors(rng, 120))] for side in "ab")
    frame = lambda rows, c: spark.createDataFrame(rows, f"s string, {c} string, v array<float>").withColumn("n", near.norm(F.col("v")))
    for cells in (40, 1 << 20):
        got = {(r.s, r.lid): (r.id, round(r.distance, 9)) for r in near.nearest(frame(a, "lid"), frame(b, "id"), ["s"], 0.3, cells).collect()}
        want = {}
        for s, i, v in a:
            d, j = min((round(cosine_far(v, w), 9), j) for t, j, w in b if t == s)
            if d <= 0.3:
                want[s, i] = (j, d)
        assert got.keys() == want.keys() and [x[1] for x in got.values()] == [want[k][1] for k in got] and len(want) > 50
        exact = {k for k, x in want.items() if x[1] == 0}
        assert exact and {k: got[k] for k in exact if got[k][1] == 0} == {k: got[k] for k in exact}


def test_links_and_components(spark):
    rng = random.Random(4)
    rows = [(rng.choice("st"), i, v) for i, v in enumerate(vectors(rng, 90))]
    d = spark.createDataFrame(rows, "s string, node long, v array<float>")
    edges = near.linked(d.where("node % 2 = 0"), d, ["s"], 0.15, 40)
    got = {r.node: r.component for r in near.components(edges).collect()}
    low = list(range(90))
    for _ in range(90):
        for s, i, v in rows:
            for t, j, w in rows:
                if s == t and (i % 2 == 0 or j % 2 == 0) and cosine_far(v, w) <= 0.15:
                    low[i] = low[j] = min(low[i], low[j])
    assert {i: got.get(i, i) for i in range(90)} == dict(enumerate(low)) and len(set(low)) < 80


def test_near_matches_of_odd_vectors(spark):
    """Vectors without a direction, copies and other lengths; both below and from distance 1 on."""
    given = {"a": [1.0, 0.0], "b": [1.0, 0.0], "c": [0.0, 0.0], "d": [1.0, 0.0, 0.0], "e": [float("nan"), 1.0], "f": None, "g": [2.0, 0.1]}
    add = lambda ids: facts(spark, [(i, i, "deductive", None, 1, 1) for i in ids]).drop("embedding").join(spark.createDataFrame([(i, given[i[0]]) for i in ids], "id string, embedding array<float>"), "id")
    new = add(["a1", "c1", "d1", "e1", "f1", "g1", "a2"]).withColumnRenamed("id", "draft_id")
    got = {r.draft_id: (r.id, round(r.distance, 6)) for r in dedup.near_matches(new, add(list("bacefg")), F.expr(NOW), 0.5).collect()}
    assert got == {"a1": ("a", 0.0), "a2": ("a", 0.0), "g1": ("g", 0.0)}
    far = {r.draft_id: (r.id, round(r.distance, 6)) for r in dedup.near_matches(new, add(list("bac")), F.expr(NOW), 1.0).collect()}
    assert far["c1"] == ("a", 1.0) == far["d1"] and far["a1"] == ("a", 0.0)


def test_one_scope_spans_groups(spark):
    """A scope is dealt into pairs of blocks, and no pair of rows is ever joined."""
    rows = spark.range(200).select(F.lit("w").alias("s"), F.col("id"), F.array(F.col("id") % 7 + 1.0, F.col("id") % 5 + 1.0).cast("array<float>").alias("v"), F.lit(1.0).alias("n"))
    sizes = near.in_pairs_of_blocks(rows, rows, ["s"], lambda a, b: a.assign(rows=len(a) * len(b))[["_i", "_j", "rows"]].head(1), "_i int, _j int, rows long", 50).collect()
    assert len(sizes) > 20 and max(r.rows for r in sizes) < 200 * 200 / 4 and sum(r.rows for r in sizes) == 200 * 200


def test_ordered_writes_in_parts(spark):
    """A scope is written in parts that share nothing, with the outcomes of writing it whole; copies and chains stay together."""
    rng = random.Random(6)
    made = [(f"f{i:03}", rng.choice(["a b c", "A b C ", "x y", f"t{i} u", f"v{i % 9} w"]), rng.choice([None, [1.0, i / 40, 0.0], [0.0, 1.0, i / 40], [0.0, 0.0, 0.0], [float(i), -1.0, 3.0]])) for i in range(160)]

    def table(rows):
        base = facts(spark, [(i, c, "deductive", None, 1, 1) for i, c, _ in rows]).drop("embedding")
        return base.join(spark.createDataFrame([(i, v) for i, _, v in rows], "id string, embedding array<float>"), "id")

    old, new = table(made[:50]), table(made[50:]).withColumns({"draft_id": F.col("id"), "position": F.substring("id", 2, 3).cast("int")})
    got = []
    for rows in (1, 10**6):
        outcomes, changed = dedup.upsert_in_order(new, old, F.expr(NOW), part_rows=rows)
        got.append((sorted(map(str, outcomes.collect())), sorted(map(str, changed.drop("embedding").collect()))))
    assert got[0] == got[1] and len(got[0][0]) == 110 and {"REPLACED", "INSERTED", "REINFORCED"} == {k for k in ("REPLACED", "INSERTED", "REINFORCED") if k in str(got[0][0])}
    live = dedup.with_derived(old).withColumn("scope_session", dedup.scope_session())
    parts = dedup._in_parts(live, live.limit(0), 0.05, 1)[0]
    assert parts.select("_part").distinct().count() > 4
    assert parts.groupBy("content_norm").agg(F.countDistinct("_part").alias("n")).where("n > 1").count() == 0
