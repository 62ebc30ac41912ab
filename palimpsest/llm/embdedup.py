"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Stage, Staging, connected_components
from palimpsest.llm.grouped import in_blocks, large_keys, per_group, roots
from palimpsest.llm.vptree import usable


def same_slot(c: float, w: float) -> float:
    """Chance that two points at distance c share a slot of width w under a random normal projection."""
    phi = 0.5 * (1 + math.erf(-w / c / math.sqrt(2)))
    return 1 - 2 * phi - 2 * c / (math.sqrt(2 * math.pi) * w) * (1 - math.exp(-(w * w) / (2 * c * c)))


def plan_tables(n: int, cosine: float, width: float, miss: float) -> tuple[int, int]:
    """Projections a table and tables: unrelated points meet about 16 others of n by chance, and two points just at the
    threshold share no bucket with probability `miss` at most."""
    near, far = same_slot(math.sqrt(max(1e-9, 2 - 2 * cosine)), width), same_slot(math.sqrt(2), width)
    k = max(2, math.ceil(math.log(max(1.0, n / 16)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - near**k)))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row dot / (norm * norm) in double precision, on the components as given; rows whose squares leave the
    range of doubles are scaled by their largest component first."""

    def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * b).sum(1)

    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        size = np.sqrt(dots(x, x)) * np.sqrt(dots(y, y))
        out = dots(x, y) / size
        far = ~((size > 1e-140) & (size < 1e140))
        if far.any():
            u, v = (a[far] / np.abs(a[far]).max(1)[:, None] for a in (x, y))
            out[far] = dots(u, v) / (np.sqrt(dots(u, u)) * np.sqrt(dots(v, v)))
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.98, width: float = 1.5, miss: float = 1e-6, block: int = 2048, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of one label link when their cosine, in double precision on the original components, is at least `cosine`.
    Equal vectors of a label are collapsed first and count as links of each other. The others are normalised and
    quantised by random projections in several tables; each bucket's pairs are checked exactly, and a pair that meets
    in several tables counts in the first. Buckets above `block` rows are dealt into pairs of blocks. What leaves a
    bucket is a count and one edge for each vector, never its pairs. What enters it is the vector as given and its codes
    in the tables before.
    Null labels, null ids, and vectors null, empty, zero or with null or non-finite components link with nothing: 0 links,
    component_id = vec_id. Vectors of unequal lengths do not link. A vec_id names one vector: rows that share an id and
    a vector count as links of each other, and all rows of an id share its component. Empty tables give empty ones.
    """
    part = F.col("_label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("_v"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_v"), F.col(label_col).cast("string").alias("_label"))
    real = np.float32 if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64

    def work(g: pa.Table) -> pa.RecordBatch | None:
        t = g.column("t")[0].as_py()
        rep, cnt, side = (g.column(c).to_numpy() for c in ("rep", "cnt", "_side"))
        data = g.column("data").to_pylist()
        if len(set(map(len, data))) > 1:  # two lengths under one hash
            return None
        x = np.frombuffer(b"".join(data), real).reshape(len(rep), -1).astype(np.float64)
        unit = x / np.abs(x).max(1)[:, None]
        unit /= np.sqrt((unit * unit).sum(1))[:, None]
        label = np.array(g.column("label").to_pylist())
        split = side.any()
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if split else (np.arange(len(rep)),) * 2
        a, b = np.nonzero(unit[left] @ unit[right].T >= cosine - 1e-9)
        a, b = left[a], right[b]
        if not split:
            a, b = a[a < b], b[a < b]
        if not len(a):
            return None
        ok = (cosines(x[a], x[b]) >= cosine) & (label[a] == label[b])
        if t:
            met = np.stack(g.column("before").to_numpy())
            ok &= ~(met[a] == met[b]).any(1)
        a, b = a[ok], b[ok]
        if not len(a):
            return None
        links = np.bincount(a, cnt[b], len(rep)) + np.bincount(b, cnt[a], len(rep))
        low = roots(len(rep), a, b)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(rep[low[some]])], names=["rep", "links", "near"])

    with Staging() as stage:
        distinct = stage(rows.where(part).groupBy("_label", "_v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("cnt")))
        n = distinct.groupBy("_label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        k, tables = plan_tables(n, cosine, width, miss)
        hashed = distinct.select("rep", "cnt", "_label", "_v").mapInArrow(_hash_rows(k, tables, width, seed, real), "rep long, cnt long, label string, data binary, codes array<long>")
        hashed = stage(hashed)
        key = F.xxhash64("label", "t", "code").alias("bucket")
        coded = hashed.select("*", F.posexplode("codes").alias("t", "code"))
        large = large_keys(coded.select("label", "t", "code").select(key), "bucket", block)
        full = coded.select(key, "t", "rep", "cnt", "label", "data", F.slice("codes", F.lit(1), F.col("t")).alias("before"))
        found = stage(per_group(in_blocks(full, "bucket", large, block), "bucket", ["t", "rep", "cnt", "label", "data", "before"], work, "rep long, links long, near long"))
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        comp = connected_components(found.select(F.col("rep").alias("a"), F.col("near").alias("b")), stage)
        known = distinct.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        known = known.select("_label", "_v", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("_links"), F.coalesce("component", "rep").alias("_comp"))
        own = rows.where(part).join(known, ["_label", "_v"]).select("vec_id", "_links", "_comp")
        other = rows.where(~F.coalesce(part, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("_links"), F.col("vec_id").alias("_comp"))
        out = Stage(own.union(other))
    return out.df().select("vec_id", F.col("_links").alias("n_links"), F.col("_comp").alias("component_id"), (F.col("vec_id") == F.col("_comp")).alias("kept"))


def _hash_rows(k: int, tables: int, width: float, seed: int, real: type):
    def run(batches):
        made: dict[int, tuple] = {}
        for b in batches:
            rep, cnt, label, v = (b.column(i) for i in range(4))
            rows = [np.asarray(x, real) for x in v.to_numpy(zero_copy_only=False)]
            for d in {len(x) for x in rows}:
                if d not in made:
                    r = np.random.default_rng([seed, d])
                    made[d] = r.standard_normal((d, k * tables)), r.uniform(0, width, k * tables), r.integers(1, 1 << 62, k) * 2 + 1
                proj, shift, mix = made[d]
                at = [i for i, x in enumerate(rows) if len(x) == d]
                u = np.stack([rows[i] for i in at]).astype(np.float64)
                u /= np.abs(u).max(1)[:, None]
                u /= np.sqrt((u * u).sum(1))[:, None]
                slots = np.floor((u @ proj + shift) / width).astype(np.int64).reshape(len(u), tables, k)
                with np.errstate(over="ignore"):
                    codes = (slots * mix).sum(2)
                    codes = (codes ^ (codes >> 29)) * np.int64(-4658895280553007687) + np.arange(tables) * np.int64(7046029254386353131) + d
                yield pa.RecordBatch.from_arrays(
                    [rep.take(pa.array(at)), cnt.take(pa.array(at)), label.take(pa.array(at)), pa.array([rows[i].tobytes() for i in at], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                    names=["rep", "cnt", "label", "data", "codes"],
                )

    return run
