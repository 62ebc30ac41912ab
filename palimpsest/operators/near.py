"""Vectors of one scope compared in blocks, as products of matrices, and what near pairs connect."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.vectors import norm
from palimpsest.sources.segments import staged

CELLS = 1 << 20  # components of the vectors in a block
TILE, PAIRS = 1 << 22, 1 << 16  # products held at once, pairs that are computed exactly at once
SMALL_SCOPES = 100_000


def directed(v: Column) -> Column:
    """Vectors that can lie nearer than 1 to another: all components finite, and not all of them zero."""
    return (norm(v) > 0) & (norm(v) < float("inf"))


def _sized(rows: DataFrame, keys: list[str], name: str, cells: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.ceil(F.sum(F.size("v")) / cells).cast("int").alias(name))


def in_pairs_of_blocks(left: DataFrame, right: DataFrame, keys: list[str], work: Callable, schema: str, cells: int = CELLS) -> DataFrame:
    """work(left rows, right rows) of each pair of blocks of a scope, the left and right rows (keys, v, more) that share `keys`.

    A scope is dealt into blocks of about `cells` vector components on either side, and each pair of blocks is a
    group: a task holds two blocks, whatever the size of a scope, and one scope spans many tasks."""
    right = right.toDF(*right.columns)  # both may be of one table
    sizes = _sized(left, keys, "_nl", cells).join(_sized(right, keys, "_nr", cells), keys)
    sizes = staged(sizes)
    sizes = F.broadcast(sizes) if sizes.count() <= SMALL_SCOPES else sizes
    deal = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(sizes, keys).withColumn("_i", deal("_nl")).withColumn("_j", every("_nr")).drop("_nl", "_nr")
    b = right.join(sizes, keys).withColumn("_j", deal("_nr")).withColumn("_i", every("_nl")).drop("_nl", "_nr")
    by = [*keys, "_i", "_j"]
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(work, schema)


def _by_length(left: pd.DataFrame, right: pd.DataFrame):
    """Rows of either side with vectors of one length, and these as matrices."""
    sizes = [d["v"].map(len).to_numpy() for d in (left, right)]
    for n in np.intersect1d(*sizes):
        at = [np.flatnonzero(s == n) for s in sizes]
        yield *at, *[np.stack(d["v"].to_numpy()[i]).astype(np.float64) for d, i in zip((left, right), at)]


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def _slack(n: int) -> float:
    """No cosine of two float32 unit vectors of n components is further off than this."""
    return 1.25e-7 * (n + 8)


def _tiles(x: np.ndarray, y: np.ndarray):
    """(first row, cosines of rows from there on with all of y), of float32 units."""
    u, w = _units(x), _units(y).T.copy()
    step = max(1, TILE // len(y))
    for s in range(0, len(x), step):
        yield s, u[s : s + step] @ w


def nearest(left: DataFrame, right: DataFrame, keys: list[str], most: float, cells: int = CELLS) -> DataFrame:
    """(keys, lid, id, distance): for each row of left (keys, lid, v, n) the row of right (keys, id, v, n) at the least cosine distance,
    ties to smaller ids, if that is at most `most`, which must be below 1. n are the norms; vectors must be `directed`.

    Products in single precision leave those that can be the nearest; their distances are then sums in double precision,
    in order of components, as vectors.cosine_distance has them."""
    if not most < 1:
        raise ValueError("vectors without a direction lie at distance 1, so that most must be below it")
    kinds = {f.name: f.dataType for f in (*left.schema.fields, *right.schema.fields)}
    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField("lid", kinds["lid"]), T.StructField("id", kinds["id"]), T.StructField("distance", T.DoubleType())])

    def work(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        b = b.sort_values("id")  # so that a smaller place is a smaller id
        an, bn = a["n"].to_numpy(), b["n"].to_numpy()
        for i, j, x, y in _by_length(a, b) if len(a) and len(b) else ():
            off = _slack(x.shape[1])
            for s, cos in _tiles(x, y):
                top = cos.max(1)
                some = np.flatnonzero(top >= 1 - most - off)
                p, q = np.nonzero(cos[some] >= (top[some] - 2 * off)[:, None])
                p = some[p] + s
                for c in range(0, len(p), PAIRS):
                    l, r = p[c : c + PAIRS], q[c : c + PAIRS]
                    dots = np.cumsum(x[l] * y[r], axis=1)[:, -1]  # adds up one after the other
                    rows.append(pd.DataFrame({"l": i[l], "r": j[r], "distance": 1 - dots / (bn[j[r]] * an[i[l]])}))
                    if len(rows) > 64:
                        rows = [best(rows)]
        d = best(rows) if rows else pd.DataFrame({"l": np.empty(0, int), "r": np.empty(0, int), "distance": np.empty(0)})
        d = d[d["distance"] <= most]
        made = {**{k: [v] * len(d) for k, v in zip(keys, key)}, "lid": a["lid"].to_numpy(object)[d["l"]], "id": b["id"].to_numpy(object)[d["r"]]}
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in made.items()} | {"distance": d["distance"].to_numpy()})

    def best(rows: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(rows).sort_values(["l", "distance", "r"]).drop_duplicates("l")

    found = in_pairs_of_blocks(left, right, keys, work, schema, cells)
    m = found.groupBy(*keys, "lid").agg(F.min(F.struct("distance", "id")).alias("m"))
    return m.select(*keys, "lid", "m.id", "m.distance")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the nodes 0 .. n-1 and edges (a, b): a node that all of one component share."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not ((up := root[root]) == root).all():
            root = up


def linked(left: DataFrame, right: DataFrame, keys: list[str], most: float, cells: int = CELLS) -> DataFrame:
    """(a, b): edges that connect the nodes of left and right rows (keys, node long, v) whose cosine distance is at most `most`, or by
    rounding little more. Of a pair of blocks come as many edges as it has nodes at most, never its pairs."""

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([a["node"].to_numpy(np.int64), b["node"].to_numpy(np.int64)]), return_inverse=True)
        root = np.arange(len(nodes))
        for i, j, x, y in _by_length(a, b) if len(a) and len(b) else ():
            for s, cos in _tiles(x, y):
                p, q = np.nonzero(cos >= 1 - most - _slack(x.shape[1]))
                p, q = root[at[i[p + s]]], root[at[len(a) + j[q]]]
                new = np.unique(np.stack([p, q], 1)[p != q], axis=0)
                root = _roots(len(nodes), new[:, 0], new[:, 1])[root]
        some = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[some], "b": nodes[root[some]]})

    return in_pairs_of_blocks(left, right, keys, work, "a long, b long", cells)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), component being the smallest node that is reachable.

    Large-star and small-star steps in turn until no edge changes; each is a minimum by node joined to its edges, so that
    a hub's edges can be split over tasks."""
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")))
        large = staged(both.where("v > u").join(low.select("u", F.least("u", "m").alias("m")), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = staged(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        mark = now
