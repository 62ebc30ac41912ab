"""Byte-pair encoding by a rank file: token counts and cuts without an outside encoder."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: A rank file is shipped to executors if it is not larger than this.
MOST_BYTES = 64 << 20
CACHE = 1 << 16


def read_ranks(lines: Iterable[str]) -> dict[bytes, int]:
    """Tokens and their ranks: a line holds the token in base64, a blank and the rank."""
    out = {}
    for line in lines:
        if line.strip():
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The piece's tokens: of all neighbours whose joint bytes are a token, those of least rank (the first, if equal) are joined, again and again.

    Pairs wait in a heap; a pair whose parts have changed meanwhile is passed over. So a piece of n bytes takes n log n
    steps, however it is made.
    """
    if len(piece) < 2 or piece in ranks:
        return [piece] if piece else []
    end = list(range(1, len(piece) + 1))  # where the part that begins here ends, or 0 if none begins here
    before, after = list(range(-1, len(piece) - 1)), list(range(1, len(piece) + 1))

    def pair(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        if j >= len(piece):
            return None
        rank = ranks.get(piece[i : end[j]])
        return None if rank is None else (rank, i, end[j])

    heap = [p for i in range(len(piece) - 1) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not end[i] or after[i] >= len(piece) or end[after[i]] != e:
            continue
        j = after[i]
        end[i], end[j] = e, 0
        after[i] = after[j]
        if after[i] < len(piece):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    return [piece[i : end[i]] for i in range(len(piece)) if end[i]]


class BytePairs:
    """An encoding for functions.tokens: encode and decode by ranks, texts first cut into pieces by a pattern.

    Bytes that no token holds have no id: a rank file holds all 256, else encode raises. Decoding replaces broken
    characters. Pieces are remembered, at most CACHE of them.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.tokens, self.pattern, self.known = ranks, {r: t for t, r in ranks.items()}, regex.compile(pattern), {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.finditer(text):
            piece = m.group().encode()
            ids = self.known.get(piece)
            if ids is None:
                ids = [self.ranks[t] for t in merged(piece, self.ranks)]
                if len(self.known) >= CACHE:
                    self.known.clear()
                if len(piece) < 256:
                    self.known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


# Fixed value: how texts are cut into pieces by default (words with the blank before them, numbers, marks, white space).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shipped(spark: SparkSession, path: str, pattern: str = PIECES):
    """(make, key) for tokens.token_count and truncate_tokens: the rank file goes to every executor once, after a check of its size."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    if size > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes; rank files up to {MOST_BYTES} are shipped")
    spark.sparkContext.addFile(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]

    def make() -> BytePairs:
        with open(SparkFiles.get(name), encoding="ascii") as f:
            return BytePairs(read_ranks(f), pattern)

    return make, f"{path}|{size}|{pattern}"
