"""A compressed full-text index: the Burrows-Wheeler transform in a wavelet tree, and matching statistics by backward search.

The wavelet tree has the shape of a prefix code whose lengths follow the symbols' frequencies, so that it takes about the
text's entropy in bits; its nodes' bits lie one after the other with counts of ones a block. All searches of a
batch go one step at a time together, as array operations.
"""

from __future__ import annotations

import numpy as np

WORD = np.uint64(64)
END = 0  # ends every text, and equals no symbol of a pattern


class Bits:
    """A bit sequence with the number of ones before any place: 64 bits and one count a word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low).astype(np.int64)


def code_lengths(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of each symbol: a prefix code with lengths of about log2(total / count), in canonical order."""
    counts = np.maximum(counts, 1)
    length = np.maximum(1, np.ceil(np.log2(int(counts.sum()) / counts) - 1e-9)).astype(np.int64)
    order = np.lexsort((np.arange(len(counts)), length))
    most = int(length.max(initial=1))
    step = np.int64(1) << (most - length[order])
    code = np.zeros(len(counts), np.int64)
    code[order] = (np.cumsum(step) - step) >> (most - length[order])
    return code, length


def parted(node: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The order that sorts by (node, bit) and keeps the order of equal ones, for nodes that are sorted already."""
    n = len(node)
    edge = np.flatnonzero(np.diff(node, prepend=-1))
    size = np.diff(np.append(edge, n))
    begin, ones = np.repeat(edge, size), np.cumsum(bit) - bit
    mine = ones - ones[begin]
    zeros = np.repeat(size - np.add.reduceat(bit, edge), size) if n else size
    place = begin + np.where(bit == 1, zeros + mine, np.arange(n) - begin - mine)
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    return order


class WaveletTree:
    """Symbols 0 .. sigma-1 of a sequence; before(c, i) counts the symbols c among the first i."""

    def __init__(self, seq: np.ndarray, sigma: int):
        code, length = code_lengths(np.bincount(seq, minlength=sigma))
        self.length = length
        self.depth = int(length.max(initial=1))
        # per level: where each symbol's node begins, and the ones before that; its bit
        self.start = np.zeros((self.depth, sigma), np.int32)
        self.bit = np.zeros((self.depth, sigma), bool)
        bits, node, at = [], np.zeros(len(seq), np.int64), 0
        now = seq
        for k in range(self.depth):
            # symbols stand sorted by node, in their first order within a node
            b = (code[now] >> (length[now] - 1 - k)) & 1
            alive = length > k
            prefix = np.where(alive, code >> np.maximum(length - k, 0), -1)
            left = np.searchsorted(node, prefix)
            self.start[k] = np.where(alive, at + left, 0)
            self.bit[k] = alive & (((code >> np.maximum(length - 1 - k, 0)) & 1) == 1)
            bits.append(b.astype(np.uint8))
            at += len(now)
            # stable parting of every node; symbols whose code ends here leave
            child = node * 2 + b
            stay = length[now] > k + 1
            child, now = child[stay], now[stay]
            order = parted(node[stay], b[stay])
            node, now = child[order], now[order]
        self.bits = Bits(np.concatenate(bits) if bits else np.zeros(0, np.uint8))
        self.ones_at = self.bits.ones(self.start.astype(np.int64))

    def before(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        out = i.copy()
        live = np.arange(len(c))
        for k in range(self.depth):
            at = self.start[k, c[live]] + out[live]
            ones = self.bits.ones(at) - self.ones_at[k, c[live]]
            out[live] = np.where(self.bit[k, c[live]], ones, out[live] - ones)
            live = live[self.length[c[live]] > k + 1]
            if not len(live):
                break
        return out


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefixes with the row before, up to depth), sorted by the first `depth` symbols at least.

    Prefix doubling: the ranks by 2^k symbols give those by 2^(k+1). Suffixes that agree that far stay in order of place.
    """
    n = len(text)
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    span = 1
    while True:
        r = ranks[-1]
        if span >= depth or int(r.max(initial=0)) == n - 1:
            break
        second = np.zeros(n, np.int64)
        second[: n - span] = r[span:] + 1 if span < n else 0
        key = r * (n + 1) + second
        order = key.argsort()  # equal keys get one rank, in whatever order they come
        step = np.diff(key[order], prepend=key[order[:1]] - 1) != 0
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(step) - 1
        ranks.append(fresh)
        span *= 2
    sa = (ranks[-1] * n + np.arange(n)).argsort()
    common = np.zeros(n, np.int64)
    a, b = sa[1:].copy(), sa[:-1].copy()
    got = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        got += same * (1 << k)
        a, b = a + same * (1 << k), b + same * (1 << k)
    common[1:] = np.minimum(got, depth)
    return sa, common


class FMIndex:
    """An index of texts, each a sequence of symbols from 1 to sigma-1; weights count how often each text occurs.

    Matches up to `depth` symbols are exact. A pattern's rows lie in [lo, hi); it occurs once a row and weight.
    """

    def __init__(self, texts: np.ndarray, ends: np.ndarray, sigma: int, depth: int):
        """texts: the symbols of all texts, one after the other; ends: where each one ends."""
        lengths = np.diff(ends, prepend=0)
        whole = np.full(len(texts) + len(ends), END, np.int64)
        whole[np.arange(len(texts)) + np.repeat(np.arange(len(ends)), lengths)] = texts
        self.n, self.depth = len(whole), depth
        sa, common = suffix_order(whole, depth + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=sigma))])
        self.tree = WaveletTree(whole[sa - 1], sigma)
        # minima of common prefixes over 2^k rows from each row on, for going up to shorter matches
        self.minima = [np.append(common, 0).astype(np.uint8 if depth < 255 else np.int32)]
        while 1 << len(self.minima) <= self.n:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of c followed by the pattern of [lo, hi): one step of backward search."""
        both = self.tree.before(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.tile(self.first[c], 2)
        return both[: len(c)], both[len(c) :]

    def shorten(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that agree with those of [lo, hi) in the first `depth` symbols."""
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.minima) - 1, -1, -1):
            low, size = self.minima[k], 1 << k
            at = lo - size + 1  # rows at .. lo all share depth symbols with the row before them
            ok = (at >= 1) & (low[np.maximum(at, 0)] >= depth)
            lo -= ok * size
            at = np.minimum(hi, len(low) - 1)
            ok = (hi + size <= self.n) & (low[at] >= depth)
            hi += ok * size
        return lo, hi

    def parent_depth(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The length of the longest shorter match that has more rows."""
        return np.maximum(self.minima[0][lo], self.minima[0][hi]).astype(np.int64)

    def count(self, pattern: np.ndarray) -> int:
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n)
        for c in pattern[::-1]:
            lo, hi = self.extend(np.array([c]), lo, hi)
        return max(0, int(hi[0] - lo[0]))

    def matching_statistics(self, texts: np.ndarray, ends: np.ndarray, enough: np.ndarray, least: int = 0) -> np.ndarray:
        """For each place of the texts how many symbols from it on occur, in `enough` rows of the index, up to depth.

        Each text is read from its end: a match grows by backward search, or gives up its last symbols until it can.
        With `least`, places from which no match of so many symbols can start any more may be left at 0.
        A symbol that the index has not got is given as -1.
        """
        out = np.zeros(len(texts), np.int64)
        begin = ends - np.diff(ends, prepend=0)
        live = np.flatnonzero(ends > begin)
        at = ends[live] - 1
        lo, hi, depth = np.zeros(len(live), np.int64), np.full(len(live), self.n), np.zeros(len(live), np.int64)
        while len(live):
            c = texts[at]
            known = c > END
            nlo, nhi = self.extend(np.where(known, c, END), lo, hi)
            ok = known & (nhi - nlo >= enough[live])
            # grown
            lo, hi = np.where(ok, nlo, lo), np.where(ok, nhi, hi)
            depth = depth + ok
            out[at[ok]] = depth[ok]
            stuck = ~ok & (depth == 0)  # the symbol itself is not there often enough
            at = at - (ok | stuck)
            # cut short: a full match loses its last symbol, one that cannot grow goes on to the next that may
            cut = (ok & (depth == self.depth)) | (~ok & (depth > 0))
            if cut.any():
                i = np.flatnonzero(cut)
                d = np.where(ok[i], self.depth - 1, np.minimum(depth[i] - 1, self.parent_depth(lo[i], hi[i])))
                d = np.where(known[i] | ok[i], d, 0)
                lo[i], hi[i] = self.shorten(lo[i], hi[i], d)
                depth[i] = d
            left = (at >= begin[live]) & (at + 1 + depth - begin[live] >= least)
            if not left.all():
                live, at, lo, hi, depth = live[left], at[left], lo[left], hi[left], depth[left]
        return out
