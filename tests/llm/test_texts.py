import difflib
import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import linededup, ngramjoin, quality, suffix
from pyspark.sql import functions as F
from tests.llm.conftest import DOC, words


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_corpus(rng):
    rows, passage = [], words(rng, 50)
    for i in range(150):
        rows.append(words(rng, rng.choice([1, 3, 5, 6, 9, 20, 60, 120, 400])))
    for base in [words(rng, n) for n in (5, 6, 7, 8, 12, 30, 70, 300, 900)]:
        for _ in range(20):
            w = base.split()
            for _ in range(rng.randrange(1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            rows.append(" \t".join(w).upper() if rng.random() < 0.3 else " ".join(w[: len(w) - rng.randrange(1 + len(w) // 10)]))
    rows += [passage + " " + words(rng, rng.choice([5, 30, 80])) for _ in range(60)]
    rows += [None, "", " \n", rows[0], rows[0], "Été A", "été a", "a b c d e f", "long " * 30000]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 8])
def test_similar_documents(write, block):
    texts = near_corpus(random.Random(7))
    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    df = write([*enumerate(texts), (3, texts[3]), (None, "x y z")], DOC)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.similar_documents(df, block=block).collect() if r.doc_id is not None)
    assert got == sorted([(i, len(s), find(i)) for i, s in enumerate(sets)] + [(3, len(sets[3]), find(3))])
    if block > 8:
        assert ngramjoin.similar_documents(write([], DOC)).count() == 0


def test_sketch_bound():
    rng = random.Random(8)
    for n in (40, 400):
        a = words(rng, n).split()
        b = a[: n // 2] + ["new"] + a[n // 2 + 1 :]
        x, y = ngramjoin.shingle_hashes(" ".join(a)), ngramjoin.shingle_hashes(" ".join(b))
        differ = len(np.setxor1d(x, y))
        bits = np.bitwise_count(ngramjoin.bit_sketch(x) ^ ngramjoin.bit_sketch(y)).sum()
        assert bits <= differ and (differ - bits) % 2 == 0
        assert set(ngramjoin.cell_keys(x)) & set(ngramjoin.cell_keys(y))


def test_line_dedup(write):
    rng = random.Random(9)
    block = [words(rng, 12) for _ in range(4)]
    own = lambda n: [words(rng, 9) for _ in range(n)]
    head = "a common heading of six words"
    docs = {
        1: [head, *own(2), *block, *own(1)], 2: [head, *own(3)], 3: [*own(1), *block[:2], "", *block[2:], *own(1)], 5: None, 6: [""], 7: ["short copy"], 8: ["short copy"], 9: ["short copy", *own(2)],
        10: [*own(1), *block[1:3]], 11: [block[0], *own(1), block[1]], 12: own(4000),
    }
    docs[13] = docs[12][:2000] + ["changed line here"] + docs[12][2001:]
    docs[14] = docs[1]
    rows = [(k, None if v is None else "\n".join(v), k * 10, "x", 1) for k, v in docs.items()] + [(None, "\n".join(docs[1]), 0, "n", 1), (14, "\n".join(docs[14]), 140, "x", 1)]
    df = write(rows, "doc_id bigint, text string, _id int, n_removed string, _gone int")
    out = linededup.dedup_lines(df).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and got[5].text is None and got[6].text == "" and got[3]["_id"] == 30 and got[3]["_gone"] == 1
    assert got[1].n_removed == 0 and got[2].n_removed == 0 and got[9].n_removed == 0 and got[12].n_removed == 0
    assert got[3].text == "\n".join([docs[3][0], docs[3][-1]]) and got[3].n_removed == 5 and got[3].removed_from == 1
    assert got[8].text == "" and got[8].removed_from == 7 and got[10].text == docs[10][0] and got[11].n_removed == 0
    assert got[13].text == "changed line here" and got[14].text == "" and got[None].n_removed == 0
    assert linededup.dedup_lines(write([], DOC)).count() == 0


def test_line_dedup_owners_apart(write):
    """A passage is found although each of its lines, and of its pairs of lines, occurs first in another document."""
    rng = random.Random(19)
    x = [words(rng, 8) for _ in range(6)]
    docs = {1: x[:2], 2: x[1:3], 3: [x[2]], 4: [x[3], "", x[4]], 5: [x[4], x[5]], 10: ["own ten", *x[:3], "", "end ten"], 11: ["own eleven", x[0], "", *x[1:3], "end"], 20: x[3:], 21: [x[3], "", *x[4:]], 30: [words(rng, 25), "", words(rng, 25)]}
    docs |= {31: [docs[30][2]], 29: [docs[30][0]]}
    docs[32] = docs[30]
    got = {r.doc_id: r for r in linededup.dedup_lines(write([(k, "\n".join(v)) for k, v in docs.items()], DOC)).collect()}
    assert got[11].text == "own eleven\nend" and got[11].n_removed == 4 and got[11].removed_from == 10
    assert got[21].text == "" and got[21].removed_from == 20 and got[20].n_removed == got[10].n_removed == 0
    assert got[32].text == "" and got[32].n_removed == 3 and got[32].removed_from == 29


def test_line_dedup_repeated_and_moved(write):
    """Against all pairs of documents by brute force: repeated and swapped passages go as well."""
    rng = random.Random(20)
    p, q = [words(rng, 9) for _ in range(3)], [words(rng, 9) for _ in range(3)]
    docs = {1: ["x", *p, "y", *p, *q, "z"], 2: ["q", *p, "r"], 3: ["s", *q, "t", *p, "u", *p, "v"]}
    hot = [words(rng, n) for n in (1, 3, 8, 8, 12, 12, 25)]
    docs |= {i: [rng.choice(hot) for _ in range(rng.randrange(1, 9))] for i in range(10, 90)}

    def brute(d):
        gone, source = set(), []
        for c in sorted(k for k in docs if k < d):
            a, b = docs[c], docs[d]
            hit = set(range(len(b))) if a == b else set()
            for s in range(len(b)):
                for e in range(s + 1, len(b) + 1):
                    if sum(len(x.split()) for x in b[s:e]) >= 20 and any(a[i : i + e - s] == b[s:e] for i in range(len(a))):
                        hit.update(range(s, e))
            gone |= hit
            source += [c] if hit else []
        return "\n".join(x for i, x in enumerate(docs[d]) if i not in gone), min(source, default=None)

    got = {r.doc_id: (r.text, r.removed_from) for r in linededup.dedup_lines(write([(k, "\n".join(v)) for k, v in docs.items()], DOC)).collect()}
    assert got == {d: brute(d) for d in docs}
    assert got[2] == ("q\nr", 1) and got[3] == ("s\nt\nu\nv", 1)


def test_patience():
    rng = random.Random(10)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(25))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(12) for _ in range(3)]
        blocks = linededup.patience_blocks(a, b)
        for i, j, k in blocks:
            assert a[i : i + k] == b[j : j + k] and k
        assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(blocks, blocks[1:]))
    a = [*range(50)]
    b = [*range(20), 99, *range(25, 50)]
    assert linededup.patience_blocks(a, b) == [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks()[:-1]]


def repeats(rows, width=50):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        own = [b[i : i + width] for i in range(len(b) - width + 1)]
        for i, w in enumerate(own):
            if w in seen:
                mask[i : i + width] = True
        seen.update(own)
        keep = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out[d] = (len(b), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(keep).hexdigest())
    return out


@pytest.mark.parametrize("collection,block", [(40_000, 60_000), (30, 8)])
def test_remove_repeats(write, collection, block):
    rng = random.Random(11)
    passages = [words(rng, n, 60) for n in (9, 10, 12, 30, 60)]
    rows = [(i, " ".join([words(rng, rng.randrange(40), 60), *rng.sample(passages, rng.randrange(3)), words(rng, rng.randrange(9), 60)])) for i in range(250)]
    rows += [(1000, "ab" * 300), (1001, "ab" * 200 + "c"), (1002, "x" * 49), (1003, "x" * 50), (1004, "x" * 51), (1005, None), (1006, ""), (1007, "é" * 40), (1008, "z" + "é" * 40), (1009, rows[3][1]), (1010, rows[3][1])]
    rows += [(2000 + i, passages[4] + str(i)) for i in range(60)]
    want = repeats(rows)
    df = write(rows + [rows[5], (None, rows[3][1])], DOC)
    got = suffix.remove_repeats(df, collection=collection, block=block).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
            assert sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_removed
    if block > 8:
        assert suffix.remove_repeats(write([], DOC)).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_column_wise(chunk, tmp_path):
    rng = random.Random(12)
    for n in range(40):
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 12))]
        folder = tmp_path / str(n)
        folder.mkdir()
        bwt, lcp, who, left = (np.concatenate(x) for x in zip(*suffix.column_wise(strings, str(folder), chunk).read()))
        key = lambda s, i, j: [x + 1 for x in s[len(s) - j :]] + [0, i]
        order = sorted(((i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)), key=lambda x: key(strings[x[0]], *x))
        # ends of strings differ, so their order by string decides between equal suffixes
        assert list(zip(who.tolist(), left.tolist())) == order
        assert [b for b in bwt] == [strings[i][len(strings[i]) - j - 1] + 1 if j < len(strings[i]) else 0 for i, j in order]
        for r in range(1, len(order)):
            (i, j), (k, m) = order[r - 1], order[r]
            a, b = strings[i][len(strings[i]) - j :], strings[k][len(strings[k]) - m :]
            n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert lcp[r] == n


def test_contexts_cover():
    rng = random.Random(13)
    for text in (words(rng, 300).encode(), b"ab" * 500, b"x" * 50, b"x" * 49, bytes(rng.randrange(65, 70) for _ in range(3000))):
        _, _, st, more = suffix.contexts(text, 50)
        starts = [s + k for s, m in zip(st, more) for k in range(m + 1)]
        assert sorted(starts) == list(range(max(0, len(text) - 49)))
        assert not len(more) or more.max() <= 50 - suffix.GRAM


def test_quality(write):
    rng = random.Random(14)
    good = lambda: ". ".join(words(rng, 9, 300) for _ in range(rng.randrange(3, 60)))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "!!!"]) + str(rng.randrange(9)) for _ in range(rng.randrange(30, 400)))
    rows = [(i, good() if i % 3 else bad(), 0.5) for i in range(600)] + [(9000, None, 0.1), (9001, "", 0.1), (9002, good() * 500, 0.1), (3, "again", 0.1)]
    docs = write(rows, "doc_id bigint, text string, score double")
    labels = write([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (8, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score_documents(docs.where("text is null or text <> 'again'"), model).collect()}
    held = {r.doc_id for r in docs.where(quality.held_out(F.col("doc_id"))).collect()}
    test = [i for i in held if i < 600]
    assert len(test) > 60 and sum(got[i].predicted == int(i % 3 > 0) for i in test) >= 0.97 * len(test)
    assert got[9000].score == got[9001].score and got[9002].predicted == 1 and all(0 <= r.score <= 1 for r in got.values())
    texts = [(t or "").encode() for _, t, _ in rows]
    one, two = quality.document_logits(model, texts), quality.document_logits(model, texts, 1500)
    assert np.abs(one - two).max() < 1e-3, [(len(texts[i]), one[i], two[i]) for i in np.argsort(-np.abs(one - two))[:4]]
    empty = write([], "doc_id bigint, text string, score double")
    assert quality.score_documents(empty, quality.fit(empty, write([], "doc_id bigint, quality int"))).count() == 0
