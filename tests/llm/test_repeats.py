"""The full-text index and the removal of repeated windows against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import fmindex, repeats

DOC = "doc_id bigint, text string"


def occurrences(texts, p):
    return sum(1 for t in texts for i in range(len(t) - len(p) + 1) if list(t[i : i + len(p)]) == list(p))


@pytest.mark.parametrize("seed", range(25))
def test_index(seed):
    rng = np.random.default_rng(seed)
    sigma, depth = int(rng.integers(2, 7)), int(rng.integers(1, 9))
    texts = [rng.integers(1, sigma, rng.integers(0, 14)) for _ in range(int(rng.integers(1, 8)))]
    index = fmindex.FMIndex(np.concatenate(texts).astype(np.int64), np.cumsum([len(t) for t in texts]), sigma, depth)
    for _ in range(8):
        p = rng.integers(1, sigma, rng.integers(1, depth + 1))
        assert index.count(p) == occurrences(texts, p)
    asked = [*texts, np.array([1, -1, 1, 1])]  # -1: a symbol that the index has not got
    enough = rng.integers(1, 4, len(asked))
    want = []
    for t, e in zip(asked, enough):
        for i in range(len(t)):
            n = 0
            while n < depth and i + n < len(t) and t[i + n] > 0 and occurrences(texts, t[i : i + n + 1]) >= e:
                n += 1
            want.append(n)
    flat, ends = np.concatenate(asked), np.cumsum([len(t) for t in asked])
    assert index.matching_statistics(flat, ends, enough).tolist() == want
    assert (index.matching_statistics(flat, ends, enough, depth) >= depth).tolist() == [n >= depth for n in want]


def test_wavelet_tree_takes_about_the_entropy():
    rng = np.random.default_rng(1)
    seq = rng.choice(200, 50_000, p=np.r_[0.9, np.full(199, 0.1 / 199)])
    tree = fmindex.WaveletTree(seq, 200)
    p = np.bincount(seq, minlength=200) / len(seq)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert len(tree.bits.words) * 64 <= len(seq) * (entropy + 1) + 64
    c, i = rng.integers(0, 200, 500), rng.integers(0, len(seq) + 1, 500)
    assert tree.before(c, i).tolist() == [int((seq[:b] == a).sum()) for a, b in zip(c, i)]


def plain_version(rows, width):
    words = [(t or "").split() for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, width):
    rng = random.Random(seed)
    word = lambda n=300: f"w{rng.randrange(n)}"
    shared = [[word() for _ in range(rng.choice([width - 1, width, width + 1, 3 * width]))] for _ in range(6)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += rng.choice([[word() for _ in range(rng.randrange(30))], rng.choice(shared), ["a", "b", "a"] * rng.randrange(12)])
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(5, rows[5][1])] * 3 + [(5, rows[6][1]), (None, rows[7][1]), (None, None), (1000, None), (1001, ""), (1002, " \n "), (1003, "x y " * 20_000)]
    # a phrase that very many documents hold, each in other words
    phrase = [f"p{j}" for j in range(width + 3)]
    rows += [(2000 + i, " ".join([*(word(10**6) for _ in range(20)), *phrase[rng.randrange(3) :], *(word(10**6) for _ in range(20))])) for i in range(80)]
    return rows


@pytest.mark.parametrize("width,gram,per_shard,hot", [(6, 2, 50, 10**6), (6, 3, 20, 5), (12, 4, 10**6, 10)])
def test_windows(spark, width, gram, per_shard, hot):
    rows = corpus(width + gram, width)
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", k1 string").repartition(6)
    got = repeats.remove_repeated_windows(docs, width, gram, per_shard, hot).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=key) == sorted(plain_version(rows, width), key=key)
    assert all(sum(s.end - s.begin for s in r.removed) == r.n_removed for r in got)
    assert sum(r.n_removed > 0 for r in got) > 50


def test_empty_table(spark):
    assert repeats.remove_repeated_windows(spark.createDataFrame([], DOC)).count() == 0


def test_minimizers_of_equal_windows_are_equal():
    rng = random.Random(3)
    shared = [b"s%d" % rng.randrange(9) for _ in range(60)]
    a = [b"a%d" % i for i in range(20)] + shared
    b = shared + [b"b%d" % i for i in range(31)]
    low = {}
    for w in (a, b):
        at, n, m, _ = repeats.contexts(w, 10, 3)
        assert at[0] == 0 and n.sum() == len(w) - 9 and n.max() <= 8
        for s, k, x in zip(at, n, m):
            for i in range(s, s + k):
                assert low.setdefault(tuple(w[i : i + 10]), x) == x
