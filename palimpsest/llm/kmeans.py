"""Lloyd's algorithm on whole-number vectors, by two trees: a cover tree over each shard of vectors, built once, and one
over the centroids, built anew each round.

A pair of nodes stands for all pairs of their points. A centroid node is dropped for a vector node when it lies, by the
triangle inequality, farther from every vector of it than some centroid does; when one centroid is left, all vectors of the node go
to it by their stored sum. Only pairs of leaves are compared point by point, in whole numbers. So the result is exactly
that of comparing every vector with every centroid.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ARROW_ROWS, Stage, Staging, partitions

LEAF = 16
PAIRS = 1 << 16


def cut_by_centres(x: np.ndarray, first: int, reach: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres among the points, more than reach apart and the given one first, each point's centre, and its distance to it (at most reach)."""
    nearest, owner, centres = np.full(len(x), np.inf), np.zeros(len(x), np.int64), []
    norm = (x * x).sum(1)
    now = first
    while True:
        d = np.maximum(0, norm + norm[now] - 2 * (x @ x[now]))
        d[now] = 0
        closer = d < nearest
        nearest[closer], owner[closer] = d[closer], len(centres)
        centres.append(now)
        now = int(nearest.argmax())
        if nearest[now] <= reach * reach:
            return centres, owner, np.sqrt(nearest)


class CoverTree:
    """A cover tree: a node's children are points of it more than half its reach apart, its own point among them, and
    every point lies within that half of its child. Points are kept in leaf order, so that a node is a stretch [b, e).

    order: the points' numbers; centre: a node's point, as a place in that order; radius: the distance of its farthest
    point; kids: [b, e) of its children among the nodes, empty in a leaf.
    """

    FIELDS = ("order", "centre", "radius", "span", "kids")

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        x = x.astype(np.float64)
        n = len(x)
        order = np.arange(n)
        centre, radius, span, kids = [0], [0.0], [(0, n)], [(0, 0)]
        if n:
            radius[0] = float(np.sqrt(((x - x[0]) ** 2).sum(1)).max())
        todo = [0] if n else []
        while todo:
            k = todo.pop()
            b, e = span[k]
            if e - b <= leaf or radius[k] == 0:  # copies of one point need no parting
                continue
            own = order[b:e]
            here, owner, far = cut_by_centres(x[own], int(np.flatnonzero(own == centre[k])[0]), radius[k] / 2)
            kids[k] = (len(centre), len(centre) + len(here))
            by = owner.argsort(kind="stable")
            ends = np.cumsum(np.bincount(owner, minlength=len(here)))
            most = np.zeros(len(here))
            np.maximum.at(most, owner, far)
            centre += [int(own[i]) for i in here]
            order[b:e] = own[by]
            for j, end in enumerate(ends):
                span.append((b + (int(ends[j - 1]) if j else 0), b + int(end)))
                radius.append(float(most[j]))
                kids.append((0, 0))
                todo.append(len(span) - 1)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.order, self.centre = order, place[np.array(centre, np.int64)] if n else np.zeros(1, np.int64)
        self.radius, self.span, self.kids = np.array(radius), np.array(span, np.int64), np.array(kids, np.int64)

    def fields(self) -> dict[str, np.ndarray]:
        return {f: getattr(self, f) for f in self.FIELDS}

    @classmethod
    def of(cls, fields) -> CoverTree:
        t = cls.__new__(cls)
        for f in cls.FIELDS:
            setattr(t, f, fields[f])
        return t


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the stretches [begin, end), and for each the stretch it is from."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[which], which


def squares(x: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs (x[i], c[j])."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), PAIRS):
        d = x[i[s : s + PAIRS]] - c[j[s : s + PAIRS]]
        out[s : s + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def nearest_centroids(tree: CoverTree, x: np.ndarray, centroids: np.ndarray, leaf: int = 2) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, int]:
    """Assign vectors (in the tree's order) to centroids, ties to the smaller number.

    Returns stretches (b, e, centroid) settled whole, the single vectors settled at the leaves with their centroids, and
    how many pairs of points were compared.
    """
    other = CoverTree(centroids, leaf)
    c = centroids[other.order]
    whole: list[tuple[int, int, int]] = []
    points, best, compared = [], [], 0
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    slack = 1e-6 * (1 + max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0))) * math.sqrt(x.shape[1]))
    while len(q):
        # pairs come sorted by vector node; bounds of distance between all points of both nodes
        d = np.sqrt(squares(x, c, tree.centre[q], other.centre[r]).astype(np.float64))
        at = np.flatnonzero(np.diff(q, prepend=-1))
        most = np.repeat(np.minimum.reduceat(d + tree.radius[q], at), np.diff(np.append(at, len(q))))
        keep = d - tree.radius[q] - other.radius[r] <= most + slack
        q, r = q[keep], r[keep]
        at = np.flatnonzero(np.diff(q, prepend=-1))
        count = np.repeat(np.diff(np.append(at, len(q))), np.diff(np.append(at, len(q))))
        single = other.span[r, 1] - other.span[r, 0] == 1
        sole = (count == 1) & single
        whole += [(int(tree.span[a, 0]), int(tree.span[a, 1]), int(other.order[other.span[b, 0]])) for a, b in zip(q[sole], r[sole])]
        q, r = q[~sole], r[~sole]
        q_leaf, r_leaf = tree.kids[q, 1] == 0, other.kids[r, 1] == 0
        # a vector node is settled at the leaf when all centroid nodes beside it are leaves as well
        at = np.flatnonzero(np.diff(q, prepend=-1))
        ready = np.repeat(np.logical_and.reduceat(q_leaf & r_leaf, at), np.diff(np.append(at, len(q)))) if len(q) else np.zeros(0, bool)
        if ready.any():
            p, pair = ranges(tree.span[q[ready], 0], tree.span[q[ready], 1])
            j, pair2 = ranges(other.span[r[ready][pair], 0], other.span[r[ready][pair], 1])
            p = p[pair2]
            compared += len(p)
            dist, number = squares(x, c, p, j), other.order[j]
            rank = np.lexsort((number, dist, p))
            first = rank[np.flatnonzero(np.diff(p[rank], prepend=-1))]
            points.append(p[first])
            best.append(number[first])
        q, r, q_leaf, r_leaf = q[~ready], r[~ready], q_leaf[~ready], r_leaf[~ready]
        # the others are parted: both nodes, or the one that has children
        qs, pair = ranges(np.where(q_leaf, q, tree.kids[q, 0]), np.where(q_leaf, q + 1, tree.kids[q, 1]))
        r, r_leaf = r[pair], r_leaf[pair]
        rs, pair = ranges(np.where(r_leaf, r, other.kids[r, 0]), np.where(r_leaf, r + 1, other.kids[r, 1]))
        q, r = qs[pair], rs
        by = np.lexsort((r, q))
        q, r = q[by], r[by]
    none = np.empty(0, np.int64)
    return whole, np.concatenate(points) if points else none, np.concatenate(best) if best else none, compared


def labels(tree: CoverTree, x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each vector's centroid, in the tree's order."""
    out = np.empty(len(x), np.int64)
    whole, points, best, _ = nearest_centroids(tree, x, centroids)
    for b, e, j in whole:
        out[b:e] = j
    out[points] = best
    return out


def largest(dims: int) -> int:
    """A bound on components below which a squared distance fits into a long."""
    return 1 << ((62 - (dims - 1).bit_length()) // 2 - 1)


def whole_vectors(vectors: DataFrame, dims: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows whose vector has dims components, none null or not finite, as floor(scale * x) in longs."""
    v = F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(largest(dims))))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == dims) & ~F.coalesce(bad, F.lit(True)))
    return d.select("id", F.transform("v", lambda x: F.floor(x)).alias("v"))


def _read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, CoverTree]:
    z = np.load(io.BytesIO(data))
    return z["ids"], z["known"], z["x"].astype(np.int64), CoverTree.of(z)


def _build(dims: int, shard_rows: int):
    def run(batches):
        ids, known, parts, have = [], [], [], 0

        def shard() -> pa.RecordBatch:
            x = np.concatenate(parts)
            tree, f = CoverTree(x), io.BytesIO()
            small = np.int16 if np.abs(x).max() < 1 << 15 else np.int32
            np.savez(f, ids=np.concatenate(ids)[tree.order], known=np.concatenate(known)[tree.order], x=x[tree.order].astype(small), **tree.fields())
            return pa.RecordBatch.from_arrays([pa.array([f.getvalue()], pa.binary())], names=["shard"])

        for b in batches:
            known.append(b.column(0).is_valid().to_numpy(zero_copy_only=False))
            ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            parts.append(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            have += b.num_rows
            if have >= shard_rows:
                yield shard()
                ids, known, parts, have = [], [], [], 0
        if have:
            yield shard()

    return run


def _sums(centroids: np.ndarray):
    """For each centroid of a task the sums of its vectors' components, and their number."""

    def run(batches):
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                _, _, x, tree = _read_shard(data)
                whole, points, best, _ = nearest_centroids(tree, x, centroids)
                upto = np.zeros((len(x) + 1, x.shape[1]), np.int64)
                np.cumsum(x, 0, out=upto[1:])  # a node's sum is a difference of two rows
                for s, e, j in whole:
                    total[j] += upto[e] - upto[s]
                    count[j] += e - s
                np.add.at(total, best, x[points])
                count += np.bincount(best, minlength=len(centroids))
        k = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(count[k]), pa.array(list(total[k]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _final(centroids: np.ndarray):
    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                ids, known, x, tree = _read_shard(data)
                own = labels(tree, x, centroids)
                d = squares(x, centroids, np.arange(len(x)), own)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(own, pa.int32()), pa.array(d)], names=["id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows of least SHA-256 of `seed:id`, in that order; rows of one id are ordered by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    got = rows.where("id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in got], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, shard_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids): every vector's centroid after the given rounds, and its squared distance.

    Vectors become whole numbers floor(scale * x). The centroids start as the k vectors of least SHA-256 of `seed:id`. A
    round assigns each vector to the nearest centroid (ties: the smaller number) and replaces each centroid that has
    vectors by floor(sum / count) of their components; empty ones stay. What goes through the driver is k centroids a
    round. Vectors that are null, of another length, or with components null, not finite or of 2^27 and more after scaling
    (whose distance a long may not hold) take no part; with fewer than k vectors there are fewer centroids; rows without id are
    clustered but never first centroids; repeated rows count each; an empty table gives no rows and no centroids. Other
    columns are not read. Shards are rows of a staged table, so that a lost executor's are read again.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dims, scale, id_col, vector_col)
    centroids = first_centroids(rows, k, seed)
    total = rows.count() if len(centroids) else 0
    if not total:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long"), centroids
    few = {ARROW_ROWS: "8"}  # a row is a shard of some hundred kilobytes
    tasks = min(math.ceil(total / shard_rows), partitions(spark))
    with Staging() as stage:
        shards = stage(rows.repartition(tasks).mapInArrow(_build(dims, shard_rows), "shard binary"), {ARROW_ROWS: str(min(shard_rows, 1024))})
        for _ in range(rounds):
            sums = shards.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("i", "x"))
            sums = Stage(sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")), few)
            fresh = centroids.copy()
            for r in sums.df().collect():  # at most k * dims rows
                fresh[r.cluster, r.i] = int(r.x) // r.n
            sums.drop()
            if (fresh == centroids).all():
                break
            centroids = fresh
        done = Stage(shards.mapInArrow(_final(centroids), "id long, cluster int, distance long"), few)
    return done.df().withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia and inertia (distances summed over the cluster and over all) and centroid_sha256 (of its components, joined by commas)."""
    spark = assigned.sparkSession
    names = [(j, ",".join(map(str, c))) for j, c in enumerate(centroids.tolist())]
    digest = spark.createDataFrame(names, "cluster int, c string").select("cluster", F.sha2("c", 256).alias("centroid_sha256"))
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia"))
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    known = per.join(digest, "cluster").crossJoin(total)  # k rows by one
    return assigned.join(F.broadcast(known), "cluster")
