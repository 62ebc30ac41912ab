"""Work on groups of rows that share a key, in bounded blocks, with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Stage, partitions, trim


class Wire:
    """Columns of fixed width packed as bytes, a few rows a scan task instead of one a value, dealt by ranges of a hash.

    The first bytes of a column's values come together, then their second bytes, and so on: bytes that hardly change,
    as those of small numbers or sorted ones, then compress to little in files and shuffles.
    """

    def __init__(self, *kinds: type):
        self.kinds, self.width = [np.dtype(k) for k in kinds], sum(np.dtype(k).itemsize for k in kinds)

    @staticmethod
    def place(key: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Range of each 64-bit hash, and the 32 bits of it below that: both grow with the hash, and together they tell hashes apart."""
        low = np.uint64(0xFFFFFFFF)
        at = (key >> np.uint64(32)) * np.uint64(ranges) + ((key & low) * np.uint64(ranges) >> np.uint64(32))
        return (at >> np.uint64(32)).astype(np.int32), (at & low).astype(np.uint32)

    def deal(self, r: np.ndarray, columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Range, number of values and packed columns of each range, for rows in order of their ranges r."""
        columns = [np.ascontiguousarray(c, k).view(np.uint8).reshape(len(r), k.itemsize) for c, k in zip(columns, self.kinds)]
        at = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r))
        return r[at[:-1]], np.diff(at), [b"".join(c[s:e].T.tobytes() for c in columns) for s, e in zip(at[:-1], at[1:])]

    def unpack(self, data: Sequence[bytes]) -> list[np.ndarray]:
        sizes = [len(d) // self.width for d in data]
        ends = np.cumsum(sizes)
        out = [np.empty((sum(sizes), k.itemsize), np.uint8) for k in self.kinds]
        for d, n, e in zip(data, sizes, ends):
            at, flat = 0, np.frombuffer(d, np.uint8)
            for c, k in zip(out, self.kinds):
                c[e - n : e] = flat[at : at + n * k.itemsize].reshape(k.itemsize, n).T
                at += n * k.itemsize
        return [c.view(k)[:, 0] for c, k in zip(out, self.kinds)]


def in_blocks(rows: DataFrame, key: str, sizes: DataFrame | None, most: int) -> DataFrame:
    """Add _i, _j and _side, and repeat rows, so that each two rows of a key meet in exactly one group (key, _i, _j).

    Keys of at most `most` rows are one group (0, 0). sizes (key, _n) lists the larger ones: their rows are dealt
    over blocks by a hash of the row, and each pair of blocks is a group; _side is 0 or 1 for the block it is of.
    """
    one = rows.withColumns({"_i": F.lit(0), "_j": F.lit(0), "_side": F.lit(0)})
    if sizes is None:
        return one
    n = F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / most).cast("int")
    held = rows.join(sizes, key, "left").withColumn("_b", n).withColumn("_m", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.col("_b")).cast("int"))
    held = held.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return held.withColumns({"_i": F.least("_m", "_o"), "_j": F.greatest("_m", "_o"), "_side": (F.col("_m") > F.col("_o")).cast("int")}).drop("_n", "_b", "_m", "_o")


def per_group(rows: DataFrame, key: str, columns: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run work on each group (key, _i, _j) of at least two rows, given as a table of `columns` and _side."""
    keys = [key, "_i", "_j"]

    def groups(batches) -> Iterator[pa.Table]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            rest.append(b)
            t = pa.Table.from_batches(rest).combine_chunks()
            change = np.zeros(max(0, t.num_rows - 1), bool)
            for k in keys:
                c = t.column(k)
                change |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False) if t.num_rows > 1 else False
            at = np.concatenate([[0], np.flatnonzero(change) + 1])
            for s, e in zip(at[:-1], at[1:]):
                if e - s > 1:
                    yield t.slice(s, e - s)
            rest = t.slice(at[-1]).to_batches()
        if rest:
            yield pa.Table.from_batches(rest).combine_chunks()

    def run(batches):
        wait, n = [], 0
        for t in groups(batches):
            if t.num_rows > 1 and (out := work(t)) is not None:
                wait.append(out)
                n += out.num_rows
                if n >= 10_000:
                    yield from pa.Table.from_batches(wait).combine_chunks().to_batches()
                    wait, n = [], 0
        if wait:
            yield from pa.Table.from_batches(wait).combine_chunks().to_batches()
        trim()

    dealt = rows.select(*keys, "_side", *columns).repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def per_groups(rows: DataFrame, key: str, columns: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str, most: int = 50_000, most_bytes: int = 32 << 20) -> DataFrame:
    """Run work on whole groups (key, _i, _j), many at a time: a table of `columns`, _i, _j and _side, and the number of each row's group.

    A table is handed over when it holds most rows or most_bytes, or one group that has more."""
    keys = [key, "_i", "_j"]

    def numbers(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.cumsum(change)

    def run(batches):
        rest: list[pa.RecordBatch] = []
        for b in batches:
            rest.append(b)
            if sum(x.num_rows for x in rest) < most and sum(x.nbytes for x in rest) < most_bytes:
                continue
            t = pa.Table.from_batches(rest).combine_chunks()
            group = numbers(t)
            last = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if last and (out := work(t.slice(0, last), group[:last])) is not None:
                yield out
            rest = t.slice(last).to_batches()
        if rest:
            t = pa.Table.from_batches(rest).combine_chunks()
            if t.num_rows and (out := work(t, numbers(t))) is not None:
                yield out
        trim()

    dealt = rows.select(*keys, "_side", *columns).repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def large_keys(rows: DataFrame, key: str, most: int) -> DataFrame | None:
    """(key, _n) of keys with more than `most` rows, or None if there is none."""
    sizes = Stage(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most))
    return None if sizes.df().isEmpty() else sizes.df()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the nodes 0 .. n-1 and edges (a, b): the smallest node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            return root
        root = new
