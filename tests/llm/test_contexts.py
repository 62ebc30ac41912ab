"""What reaches operator 10's transform: ranges of contexts that follow the data, and contexts of which something can be held twice."""

import random

import numpy as np

from palimpsest.llm import grouped, suffix


def test_ranges_of_contexts():
    """Ranges follow the bytes and not the tasks: 10^7 contexts leave none above what one task judges, also with few partitions."""
    assert [suffix.context_ranges(n) for n in (0, 1, 2_000_001, 10**9, 10**13)] == [1, 1, 2, 500, 1 << 14]
    key = np.random.default_rng(5).integers(0, 1 << 63, 10**7, np.uint64) * np.uint64(2)
    sizes = np.bincount(grouped.Wire.place(key, suffix.context_ranges(16 * len(key)))[0])
    assert len(sizes) == 80 and sizes.max() < 150_000


def test_contexts_that_may_meet():
    """Each string that several documents hold stays in all contexts that hold it, periodic texts included, and much else goes."""
    rng = random.Random(41)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    common = [word(n) for n in (26, 34, 44, 55, 70, 120)] + [b"ab" * 40, b"xyz" * 9]
    strings, docs = [], []
    for d in range(120):
        text = b"".join(word(rng.randrange(60)) + rng.choice(common) for _ in range(6))
        for _, _, st, more in zip(*suffix.contexts(text, 50)):
            strings.append(text[st : st + more + 50])
            docs.append(d)
    strings, docs = [*strings, *strings[:50]], np.array([*docs, *docs[:50]])
    held: dict[bytes, set] = {}
    for s, d in zip(strings, docs):
        for i in range(len(s) - 49):
            held.setdefault(s[i : i + 50], set()).add(d)
    begin, end = suffix.may_meet(strings, docs, 50, block=100)
    for s, b, e in zip(strings, begin, end):
        assert b == e or (0 <= b and b + 50 <= e <= len(s))
        for i in range(len(s) - 49):
            assert len(held[s[i : i + 50]]) == 1 or b <= i <= e - 50
    assert 0 < (begin < end).sum() < 0.8 * len(strings)
    assert [x.tolist() for x in suffix.may_meet([], np.empty(0, np.int64), 50)] == [[], []]
