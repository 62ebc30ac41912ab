"""Nearest neighbours by inner product with one vantage-point tree per shard."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Stage, Staging, partitions

LEAF = 256


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """Append the component that gives all rows the squared norm `most`: then the distance to (query, 0) falls as the inner product rises."""
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]], 1)


class Tree:
    """Points in leaf order, and nodes (vantage point, begin, end, children, and children's ranges of distance)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float, seed: int = 3):
        self.most, rng = float(most), np.random.default_rng(seed)
        y, order, points = lift(x, most), np.arange(len(x)), []
        nodes: list[list[float]] = []

        def build(b: int, e: int) -> int:
            k = len(nodes)
            nodes.append([0, b, e, -1, -1, 0, 0, 0, 0])
            points.append(y[order[b]])
            if e - b > LEAF:
                v = y[order[int(rng.integers(b, e))]]
                d = np.sqrt(((y[order[b:e]] - v) ** 2).sum(1))
                s = d.argsort(kind="stable")
                order[b:e] = order[b:e][s]
                d, mid = d[s], (e - b) // 2
                points[k] = v
                # the split is by position, so that equal distances (copies) still halve the points
                nodes[k][5:] = [d[0], d[mid - 1], d[mid], d[-1]]
                nodes[k][3] = build(b, b + mid)
                nodes[k][4] = build(b + mid, e)
            return k

        if len(x):
            build(0, len(x))
        self.ids, self.x = ids[order], x[order]
        self.nodes, self.points = np.array(nodes).reshape(-1, 9), np.array(points)

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, ids=self.ids, x=self.x, nodes=self.nodes, points=self.points, most=self.most)
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        t = cls.__new__(cls)
        z = np.load(io.BytesIO(data))
        t.ids, t.x, t.nodes, t.points, t.most = z["ids"], z["x"], z["nodes"], z["points"], float(z["most"])
        return t

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its k best other points, best first, ties to smaller ids.

        A child is left out when the triangle inequality's lower bound of its distances, times factor, exceeds the
        distance of the k-th best so far. Factor 1 is exact; larger ones leave out more. Queries go down together.
        """
        q = q.astype(np.float64)
        lifted = np.concatenate([q, np.zeros((len(q), 1))], 1)
        norms = (q * q).sum(1)
        best_s = [np.empty(0)] * len(q)
        best_i = [np.empty(0, self.ids.dtype)] * len(q)
        kth = np.full(len(q), -np.inf)
        x64 = self.x.astype(np.float64)
        slack = 1e-12 * (1 + self.most + norms)
        nodes, points = self.nodes, self.points

        def leaf(b: int, e: int, at: np.ndarray) -> None:
            rough = q[at] @ x64[b:e].T
            rows, cols = np.nonzero(rough >= (kth[at] - slack[at])[:, None])
            if not len(rows):
                return
            edges = np.flatnonzero(np.diff(rows)) + 1
            for r, c in zip(rows[np.concatenate([[0], edges])], np.split(cols, edges)):
                i = at[r]
                c = c[self.ids[b:e][c] != qids[i]]
                if len(c) > 4 * k:  # keep what can still be among the k best, with all ties
                    line = rough[r, c]
                    c = c[line >= np.partition(line, -k)[-k] - slack[i]]
                if not len(c):
                    continue
                # components are added one after the other, the same for every pair
                s = np.concatenate([best_s[i], np.cumsum(x64[b + c] * q[i], 1)[:, -1]])
                ids = np.concatenate([best_i[i], self.ids[b + c]])
                top = np.lexsort((ids, -s))[:k]
                best_s[i], best_i[i] = s[top], ids[top]
                if len(top) == k:
                    kth[i] = s[top[-1]]

        def visit(n: int, at: np.ndarray) -> None:
            _, b, e, inner, outer, lo0, hi0, lo1, hi1 = nodes[n]
            if inner < 0:
                leaf(int(b), int(e), at)
                return
            d = np.sqrt(((lifted[at] - points[n]) ** 2).sum(1))
            near = np.abs(d - (lo0 + hi0) / 2) - (hi0 - lo0) / 2 <= np.abs(d - (lo1 + hi1) / 2) - (hi1 - lo1) / 2
            for child, lo, hi, mask in ((inner, lo0, hi0, near), (outer, lo1, hi1, ~near), (outer, lo1, hi1, near), (inner, lo0, hi0, ~near)):
                part = at[mask]
                if len(part):
                    bound = np.maximum(0, np.maximum(d[mask] - hi, lo - d[mask]))
                    reach = np.sqrt(np.maximum(0, self.most + norms[part] - 2 * kth[part]))
                    part = part[bound * factor <= reach + 1e-9]
                    if len(part):
                        visit(int(child), part)

        if len(self.ids) and len(q):
            visit(0, np.arange(len(q)))
        return list(zip(best_i, best_s))


def _blocks(rows: DataFrame, n: int, name: str, make) -> DataFrame:
    """Deal rows evenly over n tasks; each gives one row a dimension: its number, the dimension and make(ids, vectors)."""
    from pyspark import TaskContext

    def run(batches):
        got: dict[int, list] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)):
                got.setdefault(len(v), []).append((i, v))
        for d, pairs in got.items():
            out = make(np.array([p[0] for p in pairs], np.int64), np.stack([p[1] for p in pairs]))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([d], pa.int32()), pa.array([out], pa.binary())], names=[name, "dim", f"{name}_data"])

    return rows.repartition(n).mapInArrow(run, f"{name} int, dim int, {name}_data binary")


def _dump_queries(ids: np.ndarray, x: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, ids=ids, x=x)
    return f.getvalue()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.2, shard_rows: int = 8192, block_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row its k vectors of largest inner product: query_id, rank (from 1), vec_id, score.

    Rows are dealt evenly into shards of about shard_rows; each shard's tree is one row of a staged index table. Query
    rows are dealt into blocks of block_rows, and each block meets each tree once: blocks are dealt to the shards, and a
    task loads a tree and streams its blocks. So the work, and what is shuffled, is queries times shards, as it must be
    where any shard may hold a neighbour. The shards' k best are merged by a window that keeps k rows a query. factor trades recall for time (1: exact); the index and the search leave out
    no row otherwise. A query's own id is no answer to it. Vectors null, empty, zero, or with null or non-finite
    components take no part, nor do null ids; vectors of another length than the query's are not its candidates. Equal
    scores are ordered by id; repeated candidate rows count each, repeated query rows are answered each. Fewer than k
    candidates give fewer rows, an empty table none. Other columns are not read.
    """
    pick = lambda df: df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    points, asked = pick(vectors), pick(queries)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, most = points.agg(F.count("*"), F.max(square)).first()
    wanted = asked.count()
    shards, blocks = max(1, math.ceil(total / shard_rows)), max(1, math.ceil(wanted / block_rows))
    n = partitions(vectors.sparkSession)
    slices = max(1, min(blocks, math.ceil(2 * n / shards)))  # copies of a tree, so that few shards too fill all tasks
    most = float(most or 0.0)

    def run(batches):
        now, tree = None, None
        for b in batches:
            for *key, block, data in zip(*(c.to_pylist() for c in b.columns)):
                if block < 0:
                    now, tree = key, Tree.load(data)
                    continue
                if key != now:  # no vector of the shard is as long as these queries
                    continue
                z = np.load(io.BytesIO(data))
                found = tree.search(z["ids"], z["x"], k, factor)
                sizes = [len(i) for i, _ in found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat((np.int64(block) << 32) + np.arange(len(sizes)), sizes)), pa.array(np.repeat(z["ids"], sizes)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                        names=["_q", "query_id", "vec_id", "score"],
                    )

    with Staging() as stage:
        trees = stage(_blocks(points, shards, "shard", lambda ids, x: Tree(ids, x.astype(np.float64 if x.dtype == np.float64 else np.float32), most * (1 + 1e-12)).dump()))
        asked = stage(_blocks(asked, blocks, "block", _dump_queries))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        trees = trees.withColumn("slice", every(slices)).select("shard", "slice", "dim", F.lit(-1).alias("block"), F.col("shard_data").alias("data"))
        asked = asked.withColumn("shard", every(shards)).select("shard", (F.col("block") % slices).alias("slice"), "dim", "block", F.col("block_data").alias("data"))
        dealt = trees.union(asked).repartition(n, "shard", "slice").sortWithinPartitions("shard", "slice", "dim", "block")
        # rows of a tree or a block are large, so few of them make a batch
        got = Stage(dealt.mapInArrow(run, "_q long, query_id long, vec_id long, score double"), {"spark.sql.execution.arrow.maxRecordsPerBatch": "32"}).df()
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id")))
    return got.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
