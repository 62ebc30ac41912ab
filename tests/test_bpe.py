"""Byte-pair encoding against a plain merge loop."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import bpe, tokens


def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def random_ranks(rng, size):
    """Ranks as training gives them: every token is the join of two earlier ones."""
    made = [bytes([b]) for b in range(256)]
    usual = [b for b in b"abcde \xc3\xa9"]
    some = [bytes([b]) for b in usual]
    while len(made) < 256 + size:
        t = rng.choice(some) + rng.choice(some)
        if t not in made:
            made.append(t)
            some.append(t)
    return {t: i for i, t in enumerate(made)}


@pytest.mark.parametrize("seed", range(12))
def test_merges(seed):
    rng = random.Random(seed)
    ranks = random_ranks(rng, rng.choice([0, 5, 60, 300]))
    for _ in range(150):
        piece = "".join(rng.choice("abcde é") for _ in range(rng.randrange(40))).encode()
        want = [piece] if piece in ranks else plain_merge(piece, ranks)
        assert bpe.merged(piece, ranks) == want
    assert bpe.merged(b"a" * 50_000, ranks)  # no square of the length


def test_counts_and_cuts(spark, tmp_path):
    rng = random.Random(3)
    ranks = random_ranks(rng, 200)
    path = tmp_path / "made.ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in ranks.items()))
    make, key = bpe.shipped(spark, str(path))
    texts = ["", None, "abc de", "ééé abc  abc\n", *("".join(rng.choice("abcde é\n1,") for _ in range(rng.randrange(200))) for _ in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    got = df.select("id", "text", tokens.token_count(F.col("text"), make, key).alias("n"), tokens.truncate_tokens(F.col("text"), 5, make, key).alias("cut")).collect()
    import regex

    for r in got:
        ids = [ranks[t] for p in regex.findall(bpe.PIECES, r.text or "") for t in ([p.encode()] if p.encode() in ranks else plain_merge(p.encode(), ranks))]
        assert r.n == len(ids)
        inverse = {i: t for t, i in ranks.items()}
        assert r.cut == (r.text if len(ids) <= 5 else b"".join(inverse[i] for i in ids[:5]).decode("utf-8", "replace"))


def test_large_files_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_BYTES", 3)
    (tmp_path / "x").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="shipped"):
        bpe.shipped(spark, str(tmp_path / "x"))
