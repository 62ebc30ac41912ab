"""The six ranking signals and what they are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.schemas import LEVEL_WEIGHTS
from palimpsest.settings import FusionWeights

# Fixed values: (most terms, midpoint, steepness) of the keyword curve; the last row is for all longer queries.
CURVE = [(3, 5.0, 0.7), (6, 7.0, 0.6), (9, 9.0, 0.5), (15, 10.0, 0.5), (None, 12.0, 0.5)]
K1, B = 1.2, 0.75
MS_A_DAY = 86_400_000.0


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, df: Column, n_docs: Column, length: Column, mean_length: Column) -> Column:
    """One distinct term's share. A mean length of 0 or less is the document's own; without documents it is 0."""
    mean = F.when(mean_length > 0, mean_length).otherwise(length)
    ratio = F.when(mean > 0, length / mean).otherwise(F.lit(0.0))
    part = idf(n_docs, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))
    return F.when((n_docs > 0) & (tf > 0), part).otherwise(F.lit(0.0))


def bm25_total(part: Column) -> Column:
    """The sum of the shares of a query's terms: the same for the same shares in any order, so that copies of a text tie.

    Shares are added as whole multiples of 2**-42; totals up to 2,000,000 fit, which some 30,000 of the rarest terms reach.
    """
    return F.sum(F.round(part * 2.0**42).cast("bigint")) / F.lit(2.0**42)


def keyword_curve(raw: Column, n_terms: Column) -> Column:
    """Logistic curve of a BM25 score, by the query's number of terms; nothing matched is 0."""
    mid = steep = None
    for most, m, s in CURVE:
        if most is None:
            mid, steep = (F.lit(m), F.lit(s)) if mid is None else (mid.otherwise(F.lit(m)), steep.otherwise(F.lit(s)))
        elif mid is None:
            mid, steep = F.when(n_terms <= most, F.lit(m)), F.when(n_terms <= most, F.lit(s))
        else:
            mid, steep = mid.when(n_terms <= most, F.lit(m)), steep.when(n_terms <= most, F.lit(s))
    return F.when(raw <= 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-steep * (raw - mid))))


def recency(reinforced_at: Column, now: Column, half_life_days: float) -> Column:
    days = (F.unix_millis(now) - F.unix_millis(reinforced_at)) / F.lit(MS_A_DAY)
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.when(reinforced_at.isNull() | (days <= 0), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), days / half_life_days))


def reinforcement(times_derived: Column) -> Column:
    return 1 - 1 / (1 + F.log(1 + F.greatest(F.lit(1), times_derived).cast("double")))


def count_weight(links: Column) -> Column:
    n = F.greatest(F.lit(1), links).cast("double") - 1
    return 1 / (1 + 0.001 * n * n)


def level_weight(level: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in LEVEL_WEIGHTS.items():
        out = F.when(level == name, F.lit(w)).otherwise(out)
    return out


def fused(weights: FusionWeights, sem: Column, kw: Column, ent: Column, reinf: Column, rec: Column, lvl: Column) -> Column:
    return weights.semantic * sem + weights.keyword * kw + weights.entity * ent + weights.reinforcement * reinf + weights.recency * rec + weights.level * lvl
