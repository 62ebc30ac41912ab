"""Removal of byte strings that earlier documents hold, by column-wise suffix ordering of a collection of contexts.

The Burrows-Wheeler transform of whole documents, built by one symbol of each document a round, takes as many passes
over all bytes as the longest document has bytes. So the documents are first cut into short contexts, in such a way that
equal strings of `width` bytes always meet: each such string has a minimizer (its gram of least hash), and a run
of strings with one minimizer makes a context. A collection of strings needs each different one once, so contexts that
are equal as a whole are collapsed to that of the smallest document; the different contexts of a minimizer go, all of
that minimizer together and without what no other document can hold, into collections whose transform and common
prefixes are built column by column, and there equal strings are neighbours.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ARROW_ROWS, SMALL, Stage, Staging, partitions, trim, versions
from palimpsest.llm.grouped import Wire, in_blocks, large_keys
from palimpsest.llm.ngramjoin import BYTE, _mix, _powers_to

GRAM = 20
PIECE = 1 << 20


#: A suffix as a file holds it: the transform's symbol, the common prefix (at most 255), the suffix's length and its string.
ROW = np.dtype([("bwt", np.uint8), ("lcp", np.uint8), ("left", np.uint8), ("_", np.uint8), ("who", np.uint32)])


class Files:
    """The transform, the common prefixes, and each suffix's string and length, as a file that each round reads from
    beginning to end, in chunks, and writes anew. A row is eight bytes, moved as one number."""

    def __init__(self, folder: str, chunk: int):
        self.folder, self.chunk, self.turn = folder, chunk, 0
        for turn in (0, 1):
            open(self._path(turn), "wb").close()

    def _path(self, turn: int) -> str:
        return os.path.join(self.folder, f"rows{turn}")

    def rows(self) -> Iterator[np.ndarray]:
        with open(self._path(self.turn), "rb") as f:
            while len(now := np.fromfile(f, np.uint64, self.chunk)):
                yield now

    def read(self) -> Iterator[list[np.ndarray]]:
        """Symbols, common prefixes, strings and lengths."""
        for now in self.rows():
            yield [now.view(ROW)[name] for name in ("bwt", "lcp", "who", "left")]

    def rewrite(self, chunks: Iterator[np.ndarray]) -> None:
        # a round's file is never shorter than that of the round before the last, so it is written over
        with open(self._path(1 - self.turn), "r+b") as f:
            for rows in chunks:
                rows.tofile(f)
        self.turn = 1 - self.turn


def _range_min(lcp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima of lcp[begin:end] for ranges that are not empty; taken from the back, so that reduceat skips what lies between."""
    if not len(begin):
        return np.empty(0, np.uint8)
    o = np.argsort(begin, kind="stable")[::-1]
    at = np.stack([begin[o], end[o]], 1).ravel()
    padded = np.append(lcp, np.uint8(0))
    out = np.empty(len(begin), np.uint8)
    out[o] = np.minimum.reduceat(padded, at)[::2]
    return out


def _min_to(lcp: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, int]:
    """Minima of lcp[: x + 1] for each of a few x (255 where x is -1), and that of all."""
    o = np.argsort(to)
    low = np.minimum.accumulate(np.minimum.reduceat(np.append(lcp, np.uint8(255)), np.append(0, to[o] + 1)))
    out = np.empty(len(to), np.uint8)
    out[o] = low[:-1]
    out[to < 0] = 255
    return out, low[-1]


class Scan:
    """What one sequential pass over a transform finds for the suffixes that came last: where the next symbols' suffixes go.

    A suffix goes where the last-to-first mapping of the symbol before the previous one points, and its common prefix
    with a neighbour is one more than the least one between that symbol's neighbouring occurrences. Between chunks only
    counts and minima of each symbol are kept.
    """

    def __init__(self, first: np.ndarray):
        self.next = first.copy()  # of each symbol: the row of its next occurrence's suffix
        self.seen = np.zeros(256, bool)
        self.since = np.full(256, 255, np.uint8)  # least common prefix since the symbol's last occurrence
        self.open = np.full(256, -1, np.int64)  # row of a new suffix whose next neighbour is not known yet
        self.found: list[tuple[np.ndarray, ...]] = []
        self.changed: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, bwt: np.ndarray, lcp: np.ndarray, new: np.ndarray, who: np.ndarray) -> None:
        """A chunk; new: ascending places of the last suffixes in it, who: their strings."""
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        count = np.bincount(bwt, minlength=256)
        begin = np.cumsum(count) - count
        fresh = np.zeros(n, bool)
        fresh[new] = True
        here = np.flatnonzero(count)
        head, tail = order[begin[here]], order[begin[here] + count[here] - 1]
        to_head, least = _min_to(lcp, head)
        # the first occurrence here of a symbol whose last new suffix waits for its neighbour
        waits = (self.open[here] >= 0) & ~fresh[head]
        if waits.any():
            low = np.minimum(self.since[here], to_head)[waits]
            self.changed.append((self.open[here[waits]] + 1, np.minimum(low, 254) + 1))
        self.open[here] = -1
        t = np.flatnonzero(fresh[order[count[0] :]]) + count[0]  # of the new ones that go on, by symbol and place
        if len(t):
            at = order[t]
            c = bwt[at]
            rank = t - begin[c]
            row = self.next[c] + rank
            inside = rank > 0
            prefix = np.zeros(len(t), np.uint8)
            prefix[inside] = np.minimum(_range_min(lcp, order[t[inside] - 1] + 1, at[inside] + 1), 254) + 1
            carried = np.flatnonzero(~inside & self.seen[c])
            prefix[carried] = np.minimum(np.minimum(self.since[c[carried]], to_head[np.searchsorted(here, c[carried])]), 254) + 1
            self.found.append((row, who[np.searchsorted(new, at)], prefix))
            last = rank == count[c] - 1
            after = order[np.minimum(t + 1, n - 1)]
            near = ~last & ~fresh[after]
            self.changed.append((row[near] + 1, np.minimum(_range_min(lcp, at[near] + 1, after[near] + 1), 254) + 1))
            self.open[c[last]] = row[last]
        self.since = np.minimum(self.since, least)
        self.since[here] = _min_to(lcp[::-1], n - 2 - tail)[0]
        self.seen[here] = True
        self.next += count

    def result(self) -> tuple[np.ndarray, ...]:
        """Rows, strings and prefixes of the next suffixes, and the rows and prefixes that they change, in order of rows."""
        row, who, prefix = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))
        at, low = (np.concatenate(x) for x in zip(*self.changed)) if self.changed else (np.empty(0, np.int64), np.empty(0, np.uint8))
        o, p = np.argsort(row), np.argsort(at)
        return row[o], who[o], prefix[o], at[p], low[p]


def column_wise(strings: list[bytes], folder: str, chunk: int = 1 << 17) -> Files:
    """Transform and common prefixes (at most 255) of all suffixes of the strings, in files in the folder.

    Symbols are bytes plus 1 (so that byte 255 is not allowed; UTF-8 has none); 0 ends a string, and ends are ordered by
    the strings' order. Round j inserts the symbol of each string before its suffix of length j. A round is one pass: it
    reads the files chunk by chunk, puts the new rows in, writes the result, and scans it for the next round. Beside the
    chunk it holds a few numbers a string. Strings have at most 255 bytes.
    """
    k = len(strings)
    lens = np.array([len(s) for s in strings], np.int64)
    longest = int(lens.max(initial=0))
    table = np.zeros((longest + 2, k), np.uint8)  # row j: the symbol before the suffix of length j
    flat = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    owner = np.repeat(np.arange(k), lens)
    if len(flat):
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        table[lens[owner] - 1 - offset, owner] = flat
    files = Files(folder, chunk)
    row, who, prefix, at, low = np.arange(k), np.arange(k), np.zeros(k, np.uint8), np.empty(0, np.int64), np.empty(0, np.uint8)
    total = np.zeros(256, np.int64)
    for j in range(longest + 1):
        symbol = table[j, who]
        total += np.bincount(symbol, minlength=256)
        scan = Scan(k + np.cumsum(total) - total - total[0])
        new = np.zeros(len(who), ROW)
        new["bwt"], new["lcp"], new["left"], new["who"] = symbol, prefix, j, who
        new = new.view(np.uint64)
        before = row - np.arange(len(row))  # how many old rows come before each new one

        def merged() -> Iterator[np.ndarray]:
            done = lo = 0
            old = files.rows()
            while True:
                rows = next(old, None)
                size = 0 if rows is None else len(rows)
                hi = len(row) if rows is None else int(np.searchsorted(before, done + size))
                if rows is None:
                    rows = np.empty(0, np.uint64)
                for begin in range(lo, max(hi, lo + 1), chunk):  # many new rows at one place come in several chunks
                    end = min(hi, begin + chunk)
                    final = end == hi
                    # old rows go out with the last of the new rows before them
                    cut = size if final else int(before[end - 1]) - done
                    part, rows = rows[:cut], rows[cut:]
                    base = done + begin  # the first row that goes out now
                    place = row[begin:end] - base
                    out, kept = np.empty(cut + end - begin, np.uint64), np.ones(cut + end - begin, bool)
                    kept[place] = False
                    out[kept], out[place] = part, new[begin:end]
                    done += cut
                    size -= cut
                    if len(kept):
                        s, e = np.searchsorted(at, [base, base + len(kept)])
                        view = out.view(ROW)
                        view["lcp"][at[s:e] - base] = low[s:e]
                        scan.add(view["bwt"].copy(), view["lcp"].copy(), place, who[begin:end])
                        yield out
                if hi == len(row) and not size and done == rows_before:
                    return
                lo = hi

        rows_before = int(total.sum()) - len(row)
        files.rewrite(merged())
        row, who, prefix, at, low = scan.result()
    return files


def repeated_windows(strings: list[bytes], docs: np.ndarray, width: int, folder: str | None = None, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the substrings of `width` bytes that a string of a smaller document holds too."""
    lens = np.array([len(s) for s in strings], np.int64)
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def judge(lcp: np.ndarray, who: np.ndarray, left: np.ndarray) -> None:
        """Whole groups of suffixes with equal beginnings."""
        begin = np.flatnonzero(np.append(True, lcp[1:] < width))
        low = np.repeat(np.minimum.reduceat(docs[who], begin), np.diff(np.append(begin, len(who))))
        hit = (docs[who] > low) & (left >= width)
        hits.append((who[hit].astype(np.int64), lens[who[hit]] - left[hit]))

    with tempfile.TemporaryDirectory(dir=folder) as d:
        rest = [np.empty(0, kind) for kind in (np.uint8, np.uint32, np.uint8)]
        for _, *now in column_wise(strings, d, chunk).read():
            rest = [np.concatenate(x) for x in zip(rest, now)]
            if len(ends := np.flatnonzero(rest[0][1:] < width)):
                at = int(ends[-1]) + 1  # the last group may go on
                judge(*[x[:at] for x in rest])
                rest = [x[at:] for x in rest]
        if len(rest[0]):
            judge(*rest)
    if not hits:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*hits))


def _parted(docs: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a key belongs to several documents."""
    o = np.lexsort((docs, key))
    at = np.flatnonzero(np.diff(key[o], prepend=~key[o[:1]]))
    several = docs[o][at] < docs[o][np.append(at[1:], len(o)) - 1]
    out = np.empty(len(o), bool)
    out[o] = np.repeat(several, np.diff(np.append(at, len(o))))
    return out


def may_meet(strings: list[bytes], docs: np.ndarray, width: int, gram: int = GRAM, parts: int = 4, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: begin and end of what can hold a string of `width` bytes that another document's context holds too; equal if nothing can.

    All strings of a context hold its minimizer, at most width - gram bytes after their beginning. Those that have it
    in one of `parts` ranges of places share the bytes around it that all of them cover; if no other document has these
    (by 64-bit hashes), none of these strings is held twice. Where the minimizer occurs more than once in a context, its
    places say nothing, and all contexts of that minimizer stay whole.
    """
    span, n = width - gram + 1, len(strings)
    cuts = [(span * i // parts, span * (i + 1) // parts - 1) for i in range(parts)]
    lens = np.array([len(s) for s in strings], np.int64)
    low, place, times = np.empty(n, np.uint64), np.empty(n, np.int64), np.empty(n, np.int64)
    keys, some = np.zeros((parts, n), np.uint64), np.zeros((parts, n), bool)
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        size = lens[lo:hi]
        at = np.cumsum(size) - size
        b = np.frombuffer(b"".join(strings[lo:hi]), np.uint8)
        up, down = _powers_to(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTE[b] * up[: len(b)], out=sums[1:])
        g = np.full(len(b), ~np.uint64(0))
        g[: len(b) - gram + 1] = _mix((sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1])
        over = (at + size)[:, None] - np.arange(1, gram)
        g[over.ravel()] = ~np.uint64(0)  # these reach into the next context
        low[lo:hi] = np.minimum.reduceat(g, at)
        found = np.flatnonzero(g == np.repeat(low[lo:hi], size))
        first = np.searchsorted(found, at)
        place[lo:hi] = p = found[first] - at
        times[lo:hi] = np.diff(np.append(first, len(found)))
        for k, (x, y) in enumerate(cuts):
            i = np.flatnonzero((p >= x) & (p - y <= size - width))  # a string has the minimizer x to y bytes after its beginning
            some[k, lo + i] = True
            s, e = at[i] + p[i] - x, at[i] + p[i] - y + width
            keys[k, lo + i] = _mix((sums[e] - sums[s]) * down[s])
    begin, end = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    for k, (x, y) in enumerate(cuts):
        i = np.flatnonzero(some[k])
        i = i[_parted(docs[i], keys[k, i])] if len(i) else i
        begin[i] = np.minimum(begin[i], np.maximum(place[i] - y, 0))
        end[i] = np.maximum(end[i], np.minimum(place[i] - x + width, lens[i]))
    begin = np.minimum(begin, end)
    whole = np.isin(low, low[times > 1])
    begin[whole], end[whole] = 0, lens[whole]
    return begin, end


def contexts(text: bytes, width: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, hash, start and number of strings less one of each context of a text; together they hold all its strings of `width` bytes."""
    span = width - gram + 1
    out: list[tuple] = []
    for base in range(0, max(0, len(text) - width + 1), PIECE):
        b = np.frombuffer(text[base : base + PIECE + width - 1], np.uint8)
        up, down = _powers_to(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTE[b] * up[: len(b)], out=sums[1:])
        g = _mix((sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1])
        low, s = g, 1
        while 2 * s <= span:
            low = np.minimum(low[:-s], low[s:])
            s *= 2
        n = len(b) - width + 1
        low = np.minimum(low[:n], low[span - s : span - s + n])
        start = np.flatnonzero(np.diff(low, prepend=~low[:1]))
        size = np.diff(start, append=n)
        if (size > span).any():  # a periodic text keeps its minimizer for long
            parts = -(-size // span)
            start = np.repeat(start, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * span
            size = np.diff(start, append=n)
        end = start + size - 1 + width
        # least hashes are small ones, so they are hashed anew before they are dealt by range
        out.append((_mix(low[start]), _mix((sums[end] - sums[start]) * down[start] + size.astype(np.uint64)), start + base, size - 1))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


WIRE = Wire(np.uint32, np.uint64, np.int64, np.int64, np.uint32, np.uint8)  # minimizer in its range, context's hash, document and version, start, strings less one


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans united where they meet: first of each run (index), its start and its end. In order of document and start; ends ascend too."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return at, start[at], end[np.append(at[1:], len(doc)) - 1]


def _map_contexts(width: int, ranges: int, piece: int = 4 << 20):
    """Of each piece of the scan: contexts by range of minimizers (range, n, data), and spans that are settled already."""
    names = ["range", "n", "data", "doc", "v", "st", "size"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 4]

    def emit(parts: list[tuple], docs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        m, h, st, ln = (np.concatenate(x) for x in zip(*parts))
        k = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
        doc, v = (np.array(x, np.int64) for x in zip(*docs))
        o = np.lexsort((doc[k], h, m))
        m, h, st, ln, k = (x[o] for x in (m, h, st, ln, k))
        first = np.ones(len(m), bool)
        first[1:] = (m[1:] != m[:-1]) | (h[1:] != h[:-1])
        # an equal context of a smaller document settles one here and now; only those of the smallest go on
        done = doc[k] > doc[k[np.flatnonzero(first)]][np.cumsum(first) - 1]
        if done.any():
            o = np.flatnonzero(done)
            o = o[np.lexsort((st[o], k[o]))]
            at, s, e = _runs(k[o], st[o], st[o] + ln[o] + width)
            at = k[o][at]
            blank = [pa.nulls(len(at), kind) for kind in kinds[:3]]
            yield pa.RecordBatch.from_arrays([*blank, *map(pa.array, (doc[at], v[at], s, e - s))], names=names)
        o = np.flatnonzero(~done)
        m, h, st, ln, k = (x[o] for x in (m, h, st, ln, k))
        r, m = WIRE.place(m, ranges)
        r, n, data = WIRE.deal(r, (m, h, doc[k], v[k], st, ln))
        yield pa.RecordBatch.from_arrays([pa.array(r, kinds[0]), pa.array(n, kinds[1]), pa.array(data, kinds[2]), *[pa.nulls(len(r), kind) for kind in kinds[3:]]], names=names)

    def run(batches):
        parts, docs, size, seen = [], [], 0, set()
        for b in batches:
            for d, v, t in zip(*(c.to_pylist() for c in b.columns)):
                t = t.encode()
                got = contexts(t, width) if (d, v) not in seen else ((),)
                seen.add((d, v))
                if len(got[0]):
                    parts.append(got)
                    docs.append((d, v))
                    size += len(t)
                if size >= piece:
                    yield from emit(parts, docs)
                    parts, docs, size, seen = [], [], 0, set()
        if parts:
            yield from emit(parts, docs)
        trim()

    return run


ASKED = "doc long, v long, st long, size long, gram long, h long"


def _columns(r: int, data: list[bytes], width: int) -> list[np.ndarray]:
    """Minimizer, hash, document, version, start and size in bytes of packed contexts of range r."""
    m, h, doc, v, st, ln = WIRE.unpack(data)
    return [(np.int64(r) << 32) | m.astype(np.int64), h.view(np.int64), doc, v, st.astype(np.int64), ln.astype(np.int64) + width]


def _rows(doc, v, st, size, gram, h, open_=None) -> list[pa.RecordBatch]:
    settled = None if open_ is None else ~open_
    t = pa.table([pa.array(doc), pa.array(v), pa.array(st), pa.array(size), pa.array(gram, mask=settled), pa.array(h, mask=settled)], names=["doc", "v", "st", "size", "gram", "h"])
    return t.to_batches(20_000)


def _settle(width: int):
    """Of each range: spans of contexts that a smaller document holds as a whole (gram null), and the contexts that must be compared."""

    def one(r: int, data: list[bytes]) -> list[pa.RecordBatch]:
        m, h, doc, v, st, size = _columns(r, data, width)
        o = np.lexsort((doc, h, m))
        m, h, doc, v, st, size = (x[o] for x in (m, h, doc, v, st, size))
        new_m = np.ones(len(m), bool)
        new_m[1:] = m[1:] != m[:-1]
        new_h = new_m.copy()
        new_h[1:] |= h[1:] != h[:-1]
        at_m, at_h = np.flatnonzero(new_m), np.flatnonzero(new_h)
        gm, gh = np.cumsum(new_m) - 1, np.cumsum(new_h) - 1
        done = doc > doc[at_h][gh]
        several = (np.add.reduceat(new_h.astype(np.int64), at_m) > 1) & (np.minimum.reduceat(doc, at_m) < np.maximum.reduceat(doc, at_m))
        take = done | several[gm]
        return _rows(*(x[take] for x in (doc, v, st, size, m, h)), ~done[take])

    def run(batches):
        now, data = None, []
        for b in batches:
            for r, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != now and data:
                    yield from one(now, data)
                    data = []
                now = r
                data.append(d)
        if data:
            yield from one(now, data)
        trim()

    return run


def _settle_rows(width: int):
    def run(batches):
        for b in batches:
            for r, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                gram, h, doc, v, st, size = _columns(r, [d], width)
                yield from _rows(doc, v, st, size, gram, h)

    return run


def settled(stage: Staging, mapped: DataFrame, width: int, n: int, most: int) -> DataFrame:
    """Packed contexts judged: rows of ASKED, gram null where a smaller document holds the whole context.

    A range of at most `most` contexts is sorted by one task. The others (a minimizer of a very common passage is among
    theirs) are unpacked to rows, and what is asked of them are minima by key, joined to the rows: joins that can be split.
    """
    hot = [r[0] for r in mapped.groupBy("range").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()]  # of 16,384 ranges at most
    packed = mapped.select("range", "data").where("data is not null")
    out = stage(packed.where(~F.col("range").isin(hot)).repartition(n, "range").sortWithinPartitions("range").mapInArrow(_settle(width), ASKED), SMALL)
    if not hot:
        return out
    with Staging() as inner:
        rows = inner(packed.where(F.col("range").isin(hot)).mapInArrow(_settle_rows(width), ASKED))
        same = inner(rows.groupBy("gram", "h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")))
        several = inner(same.groupBy("gram").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n > 1 and lo < hi").select("gram", F.lit(True).alias("several")))
        judged = rows.join(same.select("gram", "h", "lo"), ["gram", "h"]).join(several, "gram", "left").where("doc > lo or several")
        open_ = F.col("doc") == F.col("lo")
        more = stage(judged.select("doc", "v", "st", "size", *[F.when(open_, F.col(c)).alias(c) for c in ("gram", "h")]))
    return out.union(more)


def context_ranges(size: int, each: int = 125_000, most: int = 1 << 14) -> int:
    """Ranges of minimizers to deal the contexts of so many bytes into, some `each` contexts a range, whatever the number of
    tasks. Texts have a context some 16 bytes; a task makes a packed row a range for each 4 MB, so that `most` ranges
    leave 15 contexts a row. Only above 10^11 bytes do most ranges outgrow what one task judges; joins judge them then."""
    return max(1, min(most, -(-size // (16 * each))))


def _with_text(texts: DataFrame, rows: DataFrame, first: bool) -> DataFrame:
    """Texts and the rows about them, dealt by document and version, the text before or after its rows; no row repeats a text."""
    extra = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("doc", "v")]
    both = texts.select("doc", "v", "text", *extra).unionByName(rows.withColumn("text", F.lit(None).cast("string")))
    order = F.col("st").asc_nulls_first() if first else F.col("st").asc_nulls_last()
    return both.repartition(partitions(texts.sparkSession), "doc", "v").sortWithinPartitions("doc", "v", order)


def _cut_contexts(batches):
    now, text = None, b""
    for b in batches:
        out = []
        for doc, v, t, st, size, gram, h in zip(*(c.to_pylist() for c in b.columns)):
            if st is None:
                now, text = (doc, v), (t or "").encode()
            elif (doc, v) == now:
                out.append((doc, v, st, gram, h, text[st : st + size]))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], names=["doc", "v", "st", "gram", "h", "ctx"])


def _order(width: int, collection: int):
    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        doc, v, st, gram, h = (t.column(c).to_numpy() for c in ("doc", "v", "st", "gram", "h"))
        # occurrences of one context in one document are ordered once
        o = np.lexsort((doc, h, gram))
        first = np.ones(len(o), bool)
        g, x, d = gram[o], h[o], doc[o]
        first[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (d[1:] != d[:-1])
        some = o[first]
        string_of = np.empty(len(o), np.int64)
        string_of[o] = np.cumsum(first) - 1
        text = t.column("ctx").combine_chunks().take(pa.array(some)).to_pylist()
        begin, end = may_meet(text, doc[some], width)
        if not len(kept := np.flatnonzero(begin < end)):
            return None
        i, off = repeated_windows([text[k][begin[k] : end[k]] for k in kept], doc[some[kept]], width)
        if not len(i):
            return None
        i, off = kept[i], begin[kept[i]] + off
        k = np.lexsort((off, i))
        i, off = i[k], off[k]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (off[1:] != off[:-1] + 1)
        at = np.flatnonzero(new)
        run_i, run_off, run_len = i[at], off[at], np.diff(at, append=len(i))
        # every occurrence gets its string's runs
        begin, count = np.searchsorted(run_i, np.arange(len(some))), np.bincount(run_i, minlength=len(some))
        n = count[string_of]
        row = np.repeat(np.arange(len(doc)), n)
        k = np.repeat(begin[string_of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(v[row]), pa.array(st[row] + run_off[k]), pa.array(run_len[k] + width - 1)], names=["doc", "v", "st", "size"])

    def run(batches):
        wait: list[pa.RecordBatch] = []
        for b in batches:
            wait.append(b)
            while sum(x.num_rows for x in wait) > collection:
                t = pa.Table.from_batches(wait).combine_chunks()
                keys = np.stack([t.column(c).to_numpy() for c in ("gram", "_i", "_j")], 1)
                change = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
                if not len(change):
                    break
                at = int(change[max(0, np.searchsorted(change, collection, "right") - 1)])
                if (out := one(t.slice(0, at).to_batches())) is not None:
                    yield out
                wait = t.slice(at).to_batches()
        if wait and (out := one(wait)) is not None:
            yield out
        trim()

    return run


def _finish(batches):
    """Apply each document's spans, which come before its text, to the text; rows of one text come one after the other."""
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
    kinds = [*[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int64())] * 2]

    def one(doc: int, t: bytes, merged: list[list[int]]) -> tuple:
        sha, at, gone = hashlib.sha256(), 0, 0
        for s, e in merged:
            sha.update(t[at:s])
            gone += e - s
            at = e
        sha.update(t[at:])
        return doc, len(t), gone, len(merged), sha.hexdigest(), [s for s, _ in merged], [e for _, e in merged]

    now, merged, rows = None, [], []
    for b in batches:
        for doc, v, t, st, size in zip(*(c.to_pylist() for c in b.columns)):
            if (doc, v) != now:
                now, merged = (doc, v), []
            if st is None:
                rows.append(one(doc, (t or "").encode(), merged))
            elif merged and st <= merged[-1][1]:
                merged[-1][1] = max(st + size, merged[-1][1])
            else:
                merged.append([st, st + size])
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def remove_repeats(docs: DataFrame, width: int = 50, collection: int = 40_000, block: int = 60_000, range_most: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends.

    A byte of the UTF-8 text is removed if a string of `width` bytes covers it that also starts in a document with a
    smaller doc_id, judged on the texts as given. starts and ends are the maximal removed runs; kept_sha256 is of the
    remaining bytes. Matches never cross documents, and a document never matches itself.
    Null text is empty; texts shorter than width lose nothing. Rows with null ids neither lose nor take anything. Rows of one
    doc_id are versions of one document: each loses by its own text what smaller ids hold, and none takes from another, so
    that equal rows get equal results. An empty table gives no row; other columns are not read.
    A context that the same piece of the scan holds for a smaller document is settled there and never shuffled, so a
    common passage leaves a few rows a piece; ranges of minimizers follow the bytes of the texts, those with more than range_most contexts are judged by
    joins that can be split, and minimizers with more than `block` contexts to compare are dealt into pairs of blocks,
    so no group grows with the data. Whole contexts are held equal by 64-bit hashes next to equal minimizers; a text is
    told from other versions of its id by a 64-bit hash.
    """
    if not GRAM < width <= (255 + GRAM) // 2:
        raise ValueError(f"width must lie above {GRAM}, and contexts (up to 2 * width - {GRAM} bytes) must not exceed 255")
    spark = docs.sparkSession
    n = partitions(spark)
    texts = versions(docs, id_col, text_col)
    with Staging() as stage:
        long_enough = texts.where(F.octet_length("text") >= width)
        ranges = context_ranges(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
        with Staging() as packed:  # the largest table, which goes as soon as it has been judged
            mapped = long_enough.mapInArrow(_map_contexts(width, ranges), "range int, n long, data binary, doc long, v long, st long, size long")
            mapped = packed(mapped, {ARROW_ROWS: "2000"}, **{"parquet.block.size": 8 << 20})
            early = stage(mapped.where("data is null").select("doc", "v", "st", "size"))
            judged = settled(stage, mapped, width, n, range_most)
        asked = judged.where("gram is not null")
        large = large_keys(asked, "gram", block)
        cut = _with_text(long_enough, asked, True).select("doc", "v", "text", "st", "size", "gram", "h").mapInArrow(_cut_contexts, "doc long, v long, st long, gram long, h long, ctx binary")
        keys = ["gram", "_i", "_j"]
        dealt = in_blocks(cut, "gram", large, block).drop("_side").repartition(n, *keys).sortWithinPartitions(*keys)
        ordered = stage(dealt.mapInArrow(_order(width, collection), "doc long, v long, st long, size long"))
        spans = [early, judged.where("gram is null"), ordered]
        spans = reduce(DataFrame.union, [d.select("doc", "v", "st", "size") for d in spans])
        done = _with_text(texts, spans, False).select("doc", "v", "text", "st", "size").mapInArrow(_finish, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
        out = Stage(done).df().withColumnRenamed("doc", "doc_id")
    lone = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<long>").alias("starts"), F.array().cast("array<long>").alias("ends"),
    )
    return out.union(lone)
