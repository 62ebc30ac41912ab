"""Removal of word windows that stand anywhere else in the corpus, found by matching statistics against compressed full-text indexes.

Every document is cut into contexts: the longest runs of windows whose least gram (a minimizer, by hash) is one and the same place.
Equal windows have equal minimizers, so a shard that holds all contexts of its minimizers holds every other place of
their windows. A shard's different contexts, each with the number of its places, make one index; then they are streamed
through it, and the intervals whose match is as long as a window and has two places are reported and carried to all
documents that hold the context. A context whose minimizer has one place in the corpus cannot match and is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ARROW_ROWS, Stage, Staging, partitions, trim
from palimpsest.llm.fmindex import FMIndex
from palimpsest.llm.ngramjoin import BYTE, _mix, _powers_to

GRAM = 8
BATCH = {ARROW_ROWS: "500"}


def words_of(text: str | None) -> list[bytes]:
    """Words as bytes, parted by ASCII white space."""
    return (text or "").encode().split()


def least_of(g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each n neighbours, and the first place that has it."""

    def lesser(by: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[by:] < low[:-by]
        return np.where(right, low[by:], low[:-by]), np.where(right, at[by:], at[:-by])

    have, low, at = 1, g, np.arange(len(g))
    while 2 * have <= n:
        low, at = lesser(have)
        have *= 2
    return lesser(n - have) if n > have else (low, at)


def contexts(words: list[bytes], width: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer, hash of all its words) of each context."""
    line = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _powers_to(len(line) + 1)
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(BYTE[line] * up[: len(line)], out=sums[1:])
    gaps = np.flatnonzero(line == 32)
    s, e = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    hashed = lambda b, f: _mix((sums[f] - sums[b]) * down[b] + (f - b).astype(np.uint64))
    low, at = least_of(hashed(s[: len(s) - gram + 1], e[gram - 1 :]), width - gram + 1)
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    size = np.diff(np.append(edge, len(low)))
    return edge, size, low[edge].view(np.int64), hashed(s[edge], e[edge + size + width - 2]).view(np.int64)


def _cut(width: int, gram: int):
    def run(batches):
        for b in batches:
            k1, k2, parts, rows = b.column(0).to_numpy(), b.column(1).to_numpy(), [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                words = words_of(text)
                if len(words) >= width:
                    parts.append(contexts(words, width, gram))
                    rows.append(i)
            if rows:
                which = np.repeat(rows, [len(p[0]) for p in parts])
                at, n, low, whole = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(k1[which]), pa.array(k2[which]), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(low), pa.array(whole)], names=["k1", "k2", "at", "n", "low", "whole"])
        trim()

    return run


def _pieces(width: int, single: bool):
    """The words of listed contexts, or of each of their windows with a hash of its own."""

    def run(batches):
        seen = set()  # rows that repeat a document give its contexts once
        for b in batches:
            k1, k2 = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple] = []
            for i, (text, todo) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if (k1[i], k2[i]) in seen:
                    continue
                seen.add((k1[i], k2[i]))
                words = words_of(text)
                for c in todo:
                    if not single:
                        out.append((c["low"], c["whole"], 0, c["places"], c["low"], c["whole"], b" ".join(words[c["at"] : c["at"] + c["n"] + width - 1])))
                        continue
                    for k in range(c["n"]):
                        piece = b" ".join(words[c["at"] + k : c["at"] + k + width])
                        h = hashlib.md5(piece).digest()
                        out.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), k, c["places"], c["low"], c["whole"], piece))
            for s in range(0, len(out), 4096):
                cols = list(zip(*out[s : s + 4096]))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["a", "b", "k", "places", "low", "whole", "piece"])
        trim()

    return run


PIECE = "a long, b long, k int, places long, low long, whole long, piece binary"


def matches(pieces: list[bytes], places: np.ndarray, width: int) -> list[list[int]]:
    """One shard: for each piece its intervals [begin, end) of words, flat, all of whose windows have two places among the pieces."""
    known: dict[bytes, int] = {}
    split = [p.split(b" ") for p in pieces]
    texts = np.fromiter((known.setdefault(w, len(known) + 1) for s in split for w in s), np.int64)
    ends = np.cumsum([len(s) for s in split])
    index = FMIndex(texts, ends, len(known) + 1, width)
    # a piece that has several places is repeated wherever its rows are one
    long = index.matching_statistics(texts, ends, np.where(places > 1, 1, 2), width) >= width
    out = []
    for b, e in zip(np.concatenate([[0], ends[:-1]]), ends):
        at = np.flatnonzero(long[b:e])
        if not len(at):
            out.append([])
            continue
        new = np.flatnonzero(np.diff(at, prepend=at[0] - width - 1) > width)
        last = np.append(new[1:] - 1, len(at) - 1)
        out.append(np.stack([at[new], at[last] + width], 1).ravel().tolist())
    return out


def _search(width: int):
    def run(batches):
        now, rows = None, []

        def shard():
            found = matches([r[3] for r in rows], np.array([r[2] for r in rows]), width)
            hit = [(r[0], r[1], f) for r, f in zip(rows, found) if f]
            cols = list(zip(*hit)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["a", "b", "spans"])

        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if s != now and rows:
                    yield shard()
                    rows = []
                now = s
                rows.append(row)
        if rows:
            yield shard()
        trim()

    return run


def search_shards(pieces: DataFrame, count: int, per_shard: int, width: int) -> DataFrame:
    """(a, b, spans) of the pieces (a, b, places, piece, by): those with the same `by` meet in one shard of about per_shard pieces."""
    n = partitions(pieces.sparkSession)
    shards = max(1, -(-count // per_shard))
    dealt = pieces.select(F.pmod(F.xxhash64("by"), F.lit(shards)).alias("shard"), "a", "b", "places", "piece")
    return dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_search(width), "a long, b long, spans array<int>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2, id, text: k1 and k2 name a row's document and text, and are equal only in rows that repeat both."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return d.select(F.coalesce("id", F.lit(0)).alias("k1"), F.xxhash64("text", F.col("id").isNull()).alias("k2"), "id", "text")


def repeated_spans(rows: DataFrame, stage: Staging, width: int = 35, gram: int = GRAM, per_shard: int = 12_000, hot: int = 12_000) -> DataFrame:
    """(k1, k2, spans): the word intervals of each document (see keyed) whose windows stand anywhere else, flat, not merged.

    A minimizer with more than `hot` different contexts is not bound to one shard: its windows are told apart by a hash of
    their own, equal ones collapse to one with the sum of their places, and these are dealt over all shards.
    """
    text = rows.select("k1", "k2", "text")
    cut = Stage(text.mapInArrow(_cut(width, gram), "k1 long, k2 long, at int, n int, low long, whole long"), BATCH)
    several = Stage(cut.df().groupBy("low").agg(F.count("*").alias("m")).where("m > 1").select("low"))
    places = stage(cut.df().join(several.df(), "low", "left_semi"))
    cut.drop()
    several.drop()
    # one row stands for all places of a context; its columns are of one row, as they are taken together
    kinds = Stage(places.groupBy("low", "whole").agg(F.count("*").alias("places"), *[F.first(c).alias(c) for c in ("k1", "k2", "at", "n")]))
    per = Stage(kinds.df().groupBy("low").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("low"))
    crowded = not per.df().isEmpty()

    def pieces(of: DataFrame, single: bool) -> DataFrame:
        todo = stage(of.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n", "low", "whole", "places")).alias("todo")))
        return text.join(todo.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "todo").mapInArrow(_pieces(width, single), PIECE)

    common = kinds.df().join(per.df(), "low", "left_anti") if crowded else kinds.df()
    found = stage(search_shards(pieces(common, False).withColumn("by", F.col("low")), kinds.df().count(), per_shard, width).toDF("low", "whole", "spans"), BATCH)
    if crowded:
        windows = stage(pieces(kinds.df().join(per.df(), "low", "left_semi"), True), BATCH)
        # a window that no other place has, by its own hash, cannot match
        one = stage(windows.groupBy("a", "b").agg(F.sum("places").alias("places"), F.first("piece").alias("piece")).where("places > 1").withColumn("by", F.struct("a", "b")))
        hits = stage(search_shards(one, one.count(), per_shard, width).select("a", "b"), BATCH)
        more = windows.select("a", "b", "k", "low", "whole").join(hits, ["a", "b"], "left_semi").select("low", "whole", F.array(F.col("k"), F.col("k") + width).alias("spans"))
        found = found.union(more)
    kinds.drop()
    per.drop()
    at = places.select("low", "whole", "k1", "k2", "at").join(found, ["low", "whole"]).select("k1", "k2", F.transform("spans", lambda x: x + F.col("at")).alias("s"))
    return at.groupBy("k1", "k2").agg(F.flatten(F.collect_set("s")).alias("spans"))


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(zip(spans[::2], spans[1::2])) if spans else ():
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _keep(batches):
    for b in batches:
        out: list[tuple] = []
        for i, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            words, gone = words_of(text), merged(spans)
            kept, last = [], 0
            for s, e in gone:
                kept += words[last:s]
                last = e
            kept += words[last:]
            out.append((i, len(words), sum(e - s for s, e in gone), [{"begin": s, "end": e} for s, e in gone], b" ".join(kept).decode()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["doc_id", "n_words", "n_removed", "removed", "text"])
    trim()


def remove_repeated_windows(docs: DataFrame, width: int = 35, gram: int = GRAM, per_shard: int = 12_000, hot: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (word intervals), text (the kept words, joined by one space) of every row.

    A word goes if a window of `width` consecutive words over it has a word sequence that also starts anywhere else, in the same
    document or another; windows are judged on the input. Words are parted by ASCII white space and not changed. A null text
    has no words; texts with fewer words than a window lose none; every row is a document of its own, so rows that repeat an id
    and a text remove each other's windows; rows without id take part like others; an empty table gives no row; other
    columns are not read. Results are exact but for collisions of 64-bit hashes of contexts with one minimizer.
    """
    rows = keyed(docs, id_col, text_col)
    with Staging() as stage:
        spans = Stage(repeated_spans(rows, stage, width, gram, per_shard, hot)).df()
    return rows.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("id", "text", "spans").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, removed array<struct<begin: long, end: long>>, text string")
