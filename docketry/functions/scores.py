"""Numeric expressions shared by ranking and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranking constants.
K1 = 1.5
B = 0.75
LEXICAL_WEIGHT = 0.5
DENSE_WEIGHT = 0.5
HYBRID_WEIGHT = 0.75
RELATION_WEIGHT = 0.25
BROAD_K = 40
FINAL_K = 10
MAX_POOL = 200
MIN_DF = 2
MAX_DF = 50
SEEDS_PER_SPAN = 8
# Scores are ranked at this many decimals so that the order does not depend on
# floating-point summation order.
RANK_DECIMALS = 12


def rank_key(score: Column) -> Column:
    """Score as a whole number of rank units; plain double arithmetic, so it stays cheap
    on every row that is sorted."""
    return F.rint(score * F.lit(10.0**RANK_DECIMALS))


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_term(tf: Column, length: Column, avg_length: Column, term_idf: Column,
              k1: float = K1, b: float = B) -> Column:
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / F.greatest(avg_length, F.lit(1.0)))
    return term_idf * tf * F.lit(k1 + 1) / (tf + norm)


def is_close(lo: Column, hi: Column) -> Column:
    return F.abs(hi - lo) <= F.lit(1e-9) * F.greatest(F.abs(lo), F.abs(hi))


def min_max(value: Column, lo: Column, hi: Column) -> Column:
    flat = F.when(hi > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(is_close(lo, hi), flat).otherwise((value - lo) / (hi - lo))


def specificity(df: Column, n: Column) -> Column:
    """1 at the smallest eligible frequency, falling to 0 as the term gets common."""
    top = F.log((n + 1) / F.lit(MIN_DF + 1.0))
    raw = F.log((n + 1) / (df + F.lit(1.0))) / top
    return F.when((df < MIN_DF) | (n <= 1) | (top <= 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    )


def safe_rate(numerator: Column, denominator: Column) -> Column:
    """Ratio at six decimals; null when nothing is eligible."""
    return F.bround(F.try_divide(numerator.cast("double"), denominator.cast("double")), 6)


def l2_norm(vec: Column) -> Column:
    v = vec.cast("array<double>")
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def dot(left: Column, right: Column) -> Column:
    pairs = F.zip_with(left.cast("array<double>"), right.cast("array<double>"), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def validate_weights(lexical: float, dense: float) -> None:
    if abs(lexical + dense - 1.0) > 1e-9:
        raise ValueError("lexical and dense weights must sum to 1")
