import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from palimpsest.llm import packing, tokens
from tests.llm.conftest import DOC

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, " ", "Hello  WORLD's tale, 42 times!", "naïve Été Σς 你好 \U0001f600", "a<|endoftext|>b <|startoftext|>", "\x1c\x85 x y\n\n z", "é café", "x" * 3000, "the cat " * 2500, "'s'S 'll ²½_·"]


def test_every_base_character():
    c, e = tokens.Counter(WORD, tokens.CACHE, tokens.whole_tokens(WORD)), tokens.Encoder(BYTE, tokens.CACHE)
    base = [chr(i) for i in range(0x250)] + [chr(i) for i in range(0x2010, 0x205F)] + ["€", "́", "Σ", "你"]
    for ch in base:
        for s in (f"a{ch}a", f"1{ch}1", f" {ch} ", f"!{ch}'", ch):
            assert c.count(s) == len(c.tok.encode(s, add_special_tokens=False).ids), repr(s)
            assert e.ids(s) == e.raw(s), repr(s)
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choices(base + [" "] * 100 + list("'stremvdl") * 9 + ["<|endoftext|>"] * 3, k=rng.randint(1, 30)))
        assert c.count(s) == len(c.tok.encode(s, add_special_tokens=False).ids), repr(s)
        assert e.ids(s) == e.raw(s), repr(s)


def test_whole_tokens_are_proved():
    tok = tokens.tokenizer(WORD)
    some = sorted(tokens.whole_tokens(WORD))
    assert len(some) > 30000
    assert all(len(tok.encode(x, add_special_tokens=False).ids) == 1 for x in some[::37])


def test_counts(write):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "x y")]
    got = sorted(tokens.count_tokens(write(rows, DOC), WORD, limit=100).collect(), key=str)
    tok = tokens.tokenizer(WORD)
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == sorted([(i, b, n, n > 100) for i, b, n in want], key=str)
    assert tokens.count_tokens(write([], DOC), WORD).count() == 0


def packs(rows, limits):
    tok = tokens.tokenizer(BYTE)
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == list(np.cumsum([0, *[r.length for r in seq]])[:-1])
        assert sum(r.length for r in seq) <= limits.tokens and len(seq) <= limits.segments and sum(r.loss_tokens for r in seq) <= limits.loss_tokens
        assert [r.segment for r in seq] == list(range(len(seq)))
    return tok, by_seq, by_doc


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 50)])
def test_packed_documents(write, limits):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices(["alpha", "be", "gamma", "de ta"], k=rng.randrange(700))) for _ in range(300)] + [""] * 400
    df = write(list(enumerate(texts)), DOC)
    tok, by_seq, by_doc = packs(packing.pack_documents(df, BYTE, limits=limits).collect(), limits)
    assert len(by_doc) == len(texts)
    for d, pieces in by_doc.items():
        ids = tok.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    if limits.segments > 3:
        sizes = [sum(r.length for r in s) for s in by_seq.values()]
        assert sum(1024 - n for n in sizes if n & (n - 1)) < 0.02 * sum(sizes)
    again = packing.pack_documents(df, BYTE, limits=limits).collect()
    assert sorted(map(str, again)) == sorted(map(str, packing.pack_documents(df, BYTE, limits=limits).collect()))
    assert packing.pack_documents(write([], DOC), BYTE).count() == 0
    twice = packing.pack_documents(write([(1, "a b"), (1, "a b"), (None, None)], "doc_id bigint, text string"), BYTE).collect()
    assert sum(r.length for r in twice if r.doc_id == 1) == 2 * twice[0].doc_tokens or len(twice) == 3


def test_whole_examples(write):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 900), 0) for i in range(500)]
    rows = [(i, t, rng.randrange(t + 1)) for i, t, _ in rows]
    limits = packing.Limits(1024, 4, 600)
    rows = [(i, t, min(x, 600)) for i, t, x in rows]
    got = packing.pack_examples(write(rows, "ex int, tok int, loss int"), "ex", "tok", "loss", limits).collect()
    assert sorted((r.id, r.n_tokens, r.n_loss) for r in got) == rows
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        assert sum(r.n_tokens for r in s) <= 1024 and len(s) <= 4 and sum(r.n_loss for r in s) <= 600
    least = max(sum(t for _, t, _ in rows) / 1024, len(rows) / 4, sum(x for *_, x in rows) / 600)
    assert len(seqs) <= 1.25 * least + 3
    with pytest.raises(Exception):
        packing.pack_examples(write([(1, 2000, 0)], "ex int, tok int, loss int"), "ex", "tok", "loss").collect()
