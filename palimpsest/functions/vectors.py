"""Vectors: similarity, text form, and an embedder that needs no model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import Analyzer, bigram_tokens, tokens_bigram

FNV_OFFSET, FNV_PRIME, PROJECTIONS = 0x811C9DC5, 0x01000193, 4  # fixed values


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; null if a vector is null. A zero vector, and one of another length, has no direction to share: distance 1.

    Where each vector meets many others, norms computed before the join save two of three passes."""
    norms = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return 1 - F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0)))


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def sign_code(v: Column, bits: int = 256, seed: int = 5) -> Column:
    """A sketch of a vector's direction as 64-bit integers: the signs of `bits` random projections. Two codes differ in a share
    of bits that grows with the angle. Null vectors have null codes; equal lengths and seeds give comparable ones."""

    @F.pandas_udf("array<bigint>")
    def code(vectors: pd.Series) -> pd.Series:
        planes: dict[int, np.ndarray] = {}
        out = [None] * len(vectors)
        for i, x in enumerate(vectors):
            if x is not None:
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((len(x), bits))
                out[i] = np.packbits(np.asarray(x, np.float64) @ planes[len(x)] > 0, bitorder="little").view("<i8").tolist()
        return pd.Series(out)

    return code(v)


def code_distance(a: Column, b: Column, bits: int = 256) -> Column:
    """Number of unequal bits of two codes."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(bits // 64)), F.lit(0))


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    inner = F.btrim(text, F.lit("[] "))
    return F.when(inner == "", F.array().cast("array<float>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("float")))


def _hash32(token: str, seed: int) -> int:
    h = FNV_OFFSET ^ (seed * FNV_PRIME & 0xFFFFFFFF)
    units = np.frombuffer(token.encode("utf-16-le", "surrogatepass"), "<u2").tolist()
    for c in units:
        h = (h ^ c) * FNV_PRIME & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def hash_embedding(tokens: list[str], dims: int, cache: dict | None = None) -> np.ndarray:
    """Each token adds 1 at four hashed places; then unit length. No tokens count as the token "empty"."""
    cache = {} if cache is None else cache
    v = np.zeros(dims, np.float32)
    for t in tokens or ["empty"]:
        if t not in cache:
            cache[t] = [_hash32(t, k) % dims for k in range(PROJECTIONS)]
        for i in cache[t]:
            v[i] += 1
    return v / np.float32(np.sqrt((v.astype(np.float64) ** 2).sum()))


def embed_text(text: Column, dims: int = 1536, analyzer: Analyzer = tokens_bigram) -> Column:
    """Hashing embedder, by Arrow batch. Other analyzers than the bigram one run natively, before the batch reaches Python."""
    if analyzer is tokens_bigram:  # its lambdas would keep Spark from planning the Python function above it

        @F.pandas_udf("array<float>")
        def embed_raw(texts: pd.Series) -> pd.Series:
            cache: dict = {}
            return pd.Series([hash_embedding(bigram_tokens(t or ""), dims, cache) for t in texts])

        return embed_raw(text)

    @F.pandas_udf("array<float>")
    def embed(tokens: pd.Series) -> pd.Series:
        cache: dict = {}
        return pd.Series([hash_embedding(list(t), dims, cache) for t in tokens])

    return embed(analyzer(text))
