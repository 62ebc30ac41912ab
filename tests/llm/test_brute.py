"""Operators and the pipeline against plain versions of themselves."""

import hashlib
import math
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from palimpsest.llm import grouped, linededup, ngramjoin, packing, quality, queries, sharding, suffix, tokens
from tests.conftest import SMALL
from tests.llm.conftest import DOC, words
from tests.llm.test_texts import repeats, shingles

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def plain(value):
    return value.item() if hasattr(value, "item") else value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = c.sql(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[cols].astype(object).where(d[cols].notna(), None).values.tolist())
    assert rows(got) == rows(want)


def cut_lines(docs, min_words=20):
    """{id: text or None} with every run of lines that a smaller id holds deleted; also the number of lines deleted."""
    kept = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip()] for d, t in docs.items()}
    out = {}
    for d, t in docs.items():
        b, gone = kept[d], set()
        size = [len(x.split()) for _, x in b]
        for c in docs:
            if t is None or docs[c] is None or c >= d:
                continue
            a = [x for _, x in kept[c]]
            if b and a == [x for _, x in b]:
                gone.update(range(len(b)))
            for s in range(len(b)):
                for e in range(s + 1, len(b) + 1):
                    run = [x for _, x in b[s:e]]
                    if sum(size[s:e]) >= min_words and any(a[i : i + e - s] == run for i in range(len(a))):
                        gone.update(range(s, e))
        lines = (t or "").split("\n")
        at = sorted(b[i][0] for i in gone)
        drop = set(at)
        for i, j in zip(at, at[1:]):
            if not any(x.strip() for x in lines[i + 1 : j]):
                drop.update(range(i, j))
        out[d] = (t if t is None or not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop), len(drop))
    return out


def components(sets, percent=75):
    """Smallest key reachable by links, for {key: frozenset}."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, x in enumerate(keys):
        for y in keys[:i]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def mixed(rows, weights=(1, 2, 3), ceiling=3, seed="mix"):
    """Copies of each (id, text, source), in the order given, by the definition: shares, ceilings, crossings of integers."""
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    totals = {}
    for n, (_, _, s) in zip(size, rows):
        totals[s] = totals.get(s, 0) + n
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, todo, left = {}, list(order), sum(totals.values())
    while todo:
        level = left / sum(w[s] for s in todo)
        over = [s for s in todo if ceiling * totals[s] <= level * w[s]]
        for s in over or todo:
            target[s] = ceiling * totals[s] if over else level * w[s]
            left -= ceiling * totals[s] if over else 0
        todo = [s for s in todo if s not in target]
    out = [0] * len(rows)
    for s in order:
        offset = int(hashlib.md5(f"{seed}|{'n' if s is None else 'v' + s}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / totals[s] if totals[s] else 0
        mine = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (size[i], rows[i][0] is not None, rows[i][0]))
        for k, i in enumerate(mine):
            out[i] = min(ceiling, math.floor((k + 1) * rate + offset) - math.floor(k * rate + offset))
    return out


def plain_score(m, text):
    """The network by its definition, one frame at a time."""
    n, logits = max(1, -(-len(text) // quality.STEP_BYTES)), []
    for c in range(n):
        chunk = text[c * quality.STEP_BYTES : c * quality.STEP_BYTES + quality.CHUNK_BYTES]
        best = np.zeros(quality.FILTERS)
        for f in range(quality.CHUNK - 1):
            frame = chunk[f * quality.HALF : (f + 2) * quality.HALF]
            if frame:
                e = m.embed[list(frame.ljust(2 * quality.HALF, b"\0"))].astype(np.float64).ravel()
                best = np.maximum(best, e @ m.conv + m.bias)
        logits.append(np.maximum(best @ m.hidden + m.hidden_bias, 0) @ m.out + m.out_bias[0])
    return 1 / (1 + math.exp(-float(np.mean(logits))))


def test_network():
    m = quality.new_model(3)
    rng = random.Random(3)
    texts = [b"", b"a", b"abcdefgh", bytes(rng.randrange(1, 256) for _ in range(448)), bytes(rng.randrange(1, 256) for _ in range(3001)), ("é x " * 700).encode()]
    got = 1 / (1 + np.exp(-quality.document_logits(m, texts)))
    assert np.abs(got - [plain_score(m, t) for t in texts]).max() < 1e-5


def test_gradients():
    m = quality.Model(*[a.astype(np.float64) for a in quality.new_model(4).arrays()])
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (5, quality.CHUNK_BYTES)).astype(np.uint8)
    ok = np.arange(quality.CHUNK - 1) * quality.HALF < np.array([512, 512, 70, 3, 300])[:, None]
    doc, counts, labels = np.array([0, 0, 1, 2, 2]), np.array([2, 1, 2]), np.array([1.0, 0.0, 1.0])
    _, grads = quality.gradients(m, x, ok, doc, counts, labels)
    for p, g in zip(m.arrays(), grads):
        strong = np.argsort(-np.abs(g), axis=None)[:4]
        for i in np.concatenate([strong, rng.integers(0, p.size, 3)]):
            at, step = np.unravel_index(i, p.shape), 1e-6
            p[at] += step
            up = quality.gradients(m, x, ok, doc, counts, labels)[0]
            p[at] -= 2 * step
            down = quality.gradients(m, x, ok, doc, counts, labels)[0]
            p[at] += step
            assert abs((up - down) / (2 * step) - g[at]) < 1e-6


def test_shards(spark):
    """Every shard is the one of largest -weight / ln(u), recomputed key by key."""
    weights = [1.0, 2.5, 0.0, 1.0]
    ids = [0, 1, -5, None, 2**62, *range(100, 400)]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = {r.id: r.s for r in df.select("id", sharding.rendezvous_shard(df.id, weights, "z").alias("s")).collect()}
    for i in ids:
        key = "n" if i is None else f"k{i}"
        score = {j: -w / math.log((int(hashlib.md5(f"z{j}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) for j, w in enumerate(weights) if w}
        assert got[i] == max(score, key=score.get)


def test_repeated_ids_in_line_dedup(write):
    rng = random.Random(30)
    p, q = [words(rng, 12) for _ in range(3)], [words(rng, 12) for _ in range(3)]
    rows = [(1, "\n".join(p)), (5, "\n".join(["x", *p])), (5, "short one"), (5, "\n".join(["y", *q])), (5, "\n".join(["y", *q])), (7, "\n".join([*q, "z", *p])), (7, None), (9, "short one")]
    got = sorted(((r.doc_id, r.text, r.n_removed, r.removed_from) for r in linededup.dedup_lines(write(rows, DOC)).collect()), key=str)
    y = "\n".join(["y", *q])
    assert got == sorted([(1, "\n".join(p), 0, None), (5, "x", 3, 1), (5, "short one", 0, None), (5, y, 0, None), (5, y, 0, None), (7, "z", 6, 1), (7, None, 0, None), (9, "", 1, 5)], key=str)


@pytest.mark.parametrize("range_most", [2_000_000, 1])
def test_repeated_ids_in_suffix_dedup(write, range_most):
    """Each row by its own text; with range_most=1 every range is judged by joins."""
    rng = random.Random(31)
    long = words(rng, 40)
    rows = [(1, long), (5, long), (5, "short one"), (5, words(rng, 30) + long[:120]), (6, "short one" + long[60:200]), (6, None)]
    rows += [(10 + i, f"{words(rng, 9, 40)} {long[i:i + 90]} {words(rng, 9, 40)}") for i in range(60)]
    want = [repeats([(d, t), *[(c, u) for c, u in rows if c < d]])[d] for d, t in rows]
    df = write(rows, DOC)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, range_most=range_most, collection=50, block=20).collect()]
    assert sorted(got) == sorted((d, *w) for (d, _), w in zip(rows, want))
    assert (5, 9, 0, 0, hashlib.sha256(b"short one").hexdigest()) in got


def test_ranges_of_packed_keys():
    """Ranges follow the keys and not the tasks, and none is hot up to 2 * 10^10 keys; no keys still have a range."""
    assert [ngramjoin.key_ranges(k) for k in (0, 1, 250_001, 5_000_000, 10**9, 10**12)] == [1, 1, 2, 20, 4000, 1 << 14]
    key = np.random.default_rng(5).integers(0, 1 << 63, 10**7, np.uint64) * np.uint64(2)
    sizes = np.bincount(grouped.Wire.place(key, ngramjoin.key_ranges(len(key)))[0])
    assert len(sizes) == 40 and sizes.max() < 300_000


def test_blocks_of_heavy_keys(spark):
    """Blocks of a dense key are bounded by the bytes of their sets, and each two sets of a key still meet once."""
    rows = [(k, r, r, 2000 + 7 * (r % 300)) for k, size in ((1, 400), (2, 30), (3, 5)) for r in range(size)]
    many = spark.createDataFrame(rows, "key long, rep long, comp long, n long")
    heavy = ngramjoin.heavy_keys(many, 4096, 1 << 20)
    assert {r.key for r in heavy.collect()} == {1}
    met, held = set(), {}
    for r in grouped.in_blocks(many, "key", heavy, 4096).collect():
        held.setdefault((r.key, r._i, r._j), []).append(r)
    for (k, i, j), g in held.items():
        assert sum(8 * r.n for r in g) < 3 << 20
        pairs = {(k, min(a.rep, b.rep), max(a.rep, b.rep)) for a in g for b in g if a.rep != b.rep and (i == j or a._side != b._side)}
        assert not pairs & met
        met |= pairs
    assert len(met) == sum(n * (n - 1) // 2 for n in (400, 30, 5))
    assert ngramjoin.heavy_keys(many, 4096, 1 << 30) is None


@pytest.mark.parametrize("block_bytes", [32 << 20, 3000])
def test_dense_keys_in_blocks(write, monkeypatch, block_bytes):
    """Groups of near copies settled set against set at once, in one block or in many, as all pairs by brute force."""
    monkeypatch.setattr(ngramjoin, "ROUNDS", 0)
    rng = random.Random(37)
    rows = []
    for g in range(3):
        base = words(rng, 120).split()
        for i in range(40):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(120)] = f"y{rng.randrange(60)}"
            rows.append((100 * i + g, " ".join(w)))
    comp = components({(d, 0): shingles(t) for d, t in rows})
    want = sorted((d, len(shingles(t)), comp[(d, 0)][0]) for d, t in rows)
    out = ngramjoin.similar_documents(write(rows, DOC), block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == want


@pytest.mark.parametrize("most,range_most", [(40, 2_000_000), (0, 2_000_000), (0, 1)])
def test_repeated_ids_in_ngram_join(write, most, range_most):
    """Also with all links of larger sets left to the second pass, and that left to joins."""
    rng = random.Random(32)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = a.split()
    near[30] = "changed"
    rows = [(3, a), (5, " ".join(near)), (5, b), (5, b), (5, ""), (8, b + " more"), (8, c), (9, c), (2, c + " x y")]
    rows += [(100 + i, words(rng, rng.choice([5, 6, 7, 8, 9, 200]), 8)) for i in range(60)]
    key = lambda d, t: (d, zlib.crc32((t or "").encode()))
    comp = components({key(d, t): shingles(t) for d, t in rows})
    want = sorted((d, len(shingles(t)), comp[key(d, t)][0]) for d, t in rows)
    out = ngramjoin.similar_documents(write(rows, DOC), most=most, range_most=range_most).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    groups = {comp[key(d, t)] for d, t in rows if shingles(t)}
    assert len({(r.doc_id, r.text_hash) for r in out if r.keeper and r.n_shingles}) == len(groups)


def test_dense_keys():
    """A key whose documents can nearly all link: each names its nearest, and what then is left is linked set by set."""
    rng = random.Random(36)
    bases = [words(rng, 80).split() for _ in range(3)]
    sets = []
    for i in range(90):
        w = list(bases[i % 3])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(80)] = f"x{rng.randrange(50)}"
        sets.append(ngramjoin.shingle_hashes(" ".join(w)))
    n = len(sets)
    for side in (np.zeros(n, np.int64), np.arange(n) % 2):
        split = int(side.any())
        t = pa.table({"key": [7] * n, "_i": [0] * n, "_j": [split] * n, "_side": side, "rep": np.arange(n) + 100, "comp": np.arange(n) + 100, "n": [len(h) for h in sets], "bits": [ngramjoin.bit_sketch(h).tobytes() for h in sets], "h": [h.tobytes() for h in sets]})
        asked = ngramjoin._cross(75, few=1)(t, np.zeros(n, np.int64))
        assert all(asked.column("dense").to_pylist()) and len(asked) == n
        apart = {(a, b) for a in range(n) for b in range(a) if side[a] != side[b] or not split}
        for a, b in zip(asked.column("rep").to_pylist(), asked.column("other").to_pylist()):
            assert (max(a, b) - 100, min(a, b) - 100) in apart and len(np.intersect1d(sets[a - 100], sets[b - 100]))
        every = ngramjoin._cross(75, few=10**6)(t, np.zeros(n, np.int64))
        links = {(a, b) for a, b in apart if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
        proposed = {(max(a, b) - 100, min(a, b) - 100) for a, b in zip(every.column("rep").to_pylist(), every.column("other").to_pylist())}
        assert not any(every.column("dense").to_pylist()) and links <= proposed <= apart
        made = ngramjoin._link(75)(t)
        got = {(b - 100, a - 100) for a, b in zip(made.column("a").to_pylist(), made.column("b").to_pylist())}
        assert got <= links
        root = lambda edges: grouped.roots(n, *(np.array(x, np.int64) for x in zip(*edges))).tolist()
        assert root(got) == root(links)


def test_pairs_of_groups():
    rng = np.random.default_rng(37)
    group = np.repeat(np.arange(60), [*rng.integers(1, 9, 50), *rng.integers(60, 150, 10)])
    got = [(int(a), int(b)) for x, y in ngramjoin._pairs(group, most=500) for a, b in zip(x, y)]
    assert sorted(got) == [(a, b) for a in range(len(group)) for b in range(a + 1, len(group)) if group[a] == group[b]]


def test_packed_conversations(write):
    rng = random.Random(33)
    tok = tokens.tokenizer(BYTE)
    turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", words(rng, rng.choice([3, 30, 300]), 500)])) for c in range(80) for t in range(rng.randrange(1, 7))]
    turns += [(None, 0, "assistant", "a b"), (None, 0, "user", "c"), turns[0], (500, 0, "assistant", words(rng, 3000, 500))]
    limits = packing.Limits(512, 3, 200)
    schema = "conv_id bigint, turn bigint, role string, text string"
    got = packing.pack_conversations(write(turns, schema), BYTE, limits=limits).collect()
    want, loss = {}, {}
    for c, _, role, text in turns:
        n = len(tok.encode(text or "", add_special_tokens=False).ids) + 1
        want[c], loss[c] = want.get(c, 0) + n, loss.get(c, 0) + n * (role == "assistant")
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert {c: (sum(r.n_tokens for r in rs), sum(r.n_loss for r in rs)) for c, rs in by.items()} == {c: (want[c], loss[c]) for c in want}
    assert all(sorted(r.part for r in rs) == list(range(len(rs))) for c, rs in by.items() if c is not None) and len(by[None]) == 2
    bound = [0, 0, 0]
    for rs in seqs.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(np.cumsum([0, *[r.n_tokens for r in rs]])[:-1])
        used = (sum(r.n_tokens for r in rs), len(rs), sum(r.n_loss for r in rs))
        assert used <= (512, 9, 999) and used[1] <= 3 and used[2] <= 200
        for i, most in enumerate((500, 3, 195)):
            bound[i] += used[i] >= most
    assert min(bound) > 0, "each limit binds somewhere"
    assert packing.pack_conversations(write([], schema), BYTE).count() == 0


def test_pipeline(spark, tmp_path):
    """All stages on one corpus, each against its plain version on what the one before kept."""
    rng = random.Random(34)
    passage = [words(rng, 12) for _ in range(4)]
    rows, labels = [], []
    for i in range(150):
        bad = i % 5 == 0
        lines = [" ".join(rng.choice(["BUY", "NOW", "$$$"]) for _ in range(60))] if bad else [words(rng, 14) for _ in range(rng.randrange(2, 8))]
        if not bad and i % 7 == 1:
            lines[1:1] = passage
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", "b", None])))
        labels.append((i, int(not bad)))
    for k in range(12):
        w = rows[k * 5 + 1][1].replace("\n", " ").split(" ")
        w[k % len(w)] = "changed"
        rows.append((300 + k, " ".join(w), "a"))
    rows += [(400, None, "b"), (401, "", None), rows[6]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    tuples = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)
    stage = dict(corpus_pipeline.STAGES)

    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = stage["quality classifier"](spark, docs, str(tmp_path))
    want = [r for r in rows if plain_score(model, (r[1] or "").encode()) >= 0.3]
    assert tuples(good) == sorted(want, key=str) and 0 < len(want) < len(rows)

    cut = stage["line dedup"](spark, good, str(tmp_path))
    done = cut_lines({d: t for d, t, _ in want})
    want = [(d, done[d][0], s) for d, _, s in want if not done[d][1] or done[d][0].strip()]
    assert tuples(cut) == sorted(want, key=str) and any(n for _, n in done.values())

    one = stage["n-gram Jaccard join"](spark, cut, str(tmp_path))
    comp = components({d: shingles(t) for d, t, _ in want})
    want = sorted({r for r in want if comp[r[0]] == r[0]}, key=str)
    assert tuples(one) == want and any(comp[d] != d for d in comp)

    mix = stage["mixing sources"](spark, one, str(tmp_path))
    want = sorted((r for r, n in zip(want, mixed(want)) for _ in range(n)), key=str)
    assert tuples(mix) == want

    packed = stage["packing"](spark, mix, str(tmp_path)).collect()
    tok, length = tokens.tokenizer(BYTE), {}
    for d, t, _ in want:
        length[d] = length.get(d, 0) + len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        ids = tok.encode(next(t for d, t, _ in want if d == r.doc_id) or "", add_special_tokens=False).ids + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert got == length
    whole = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in whole} == length


def test_stages_with_long_texts_and_ties(spark, tmp_path):
    """Very long texts, ties in every order, null ids by the dozen, and repeated ids with other texts."""
    rng = random.Random(35)
    long = "\n".join(words(rng, 20) for _ in range(4000))
    rows = [(1, long, "a"), (2, long + "\nend of it", "a"), (3, "x " * 100_000, "b"), *[(None, f"lone {i % 3}", "b") for i in range(40)], (7, "one text here", "c"), (7, "another text there", "c"), (7, "one text here", "c")]
    rows += [(10 + i, "a tie of five words", "d") for i in range(6)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs, stage = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    cut = stage["line dedup"](spark, docs, str(tmp_path))
    got = sorted(((r.doc_id, r.text) for r in cut.collect()), key=str)
    assert (2, "end of it") in got and sum(d is None for d, _ in got) == 40 and sum(d == 7 for d, _ in got) == 3 and [d for d, _ in got if d and 10 <= d] == [10]
    one = stage["n-gram Jaccard join"](spark, docs, str(tmp_path))
    ids = sorted((r.doc_id for r in one.collect()), key=str)
    assert ids == sorted([1, 3, 7, 7, 10, *[None] * 40], key=str)
    mix = stage["mixing sources"](spark, docs, str(tmp_path)).collect()
    want = mixed(sorted(rows, key=str))
    assert len(mix) == sum(want) and sum(r.doc_id is None for r in mix) == sum(n for r, n in zip(sorted(rows, key=str), want) if r[0] is None)
    assert stage["packing"](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_wide_sketches():
    """Distances of sketches of all widths are those of the narrower width, never above the sets' difference, and tell unrelated large sets apart."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (3, 900, 1500, 4000, 4100, 9000, 40_000, 70_000)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 50, np.uint64)]) for s in sets[1:]]
    data = [ngramjoin.bit_sketch(s, ngramjoin.sketch_bits(len(s))).tobytes() for s in sets]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    for most in (1 << 12, 1 << 25):
        got = ngramjoin.Sketches(data).distance(a, b, most)
        for i, j, d in zip(a, b, got):
            bits = min(ngramjoin.sketch_bits(len(sets[i])), ngramjoin.sketch_bits(len(sets[j])))
            assert d == np.bitwise_count(ngramjoin.bit_sketch(sets[i], bits) ^ ngramjoin.bit_sketch(sets[j], bits)).sum()
            assert d <= len(np.setxor1d(sets[i], sets[j]))
    far = ngramjoin.Sketches(data).distance(np.array([3, 4]), np.array([4, 3]))
    assert (175 * far > ngramjoin._bound(4000, 4100, 75)).all()
