"""Exact binomial tails and their inversions, for tables of one row per group, through the incomplete beta function."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HALVINGS = 60


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function for a, b > 0, by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        # The fraction converges fast on one side of the mean; the other side is its mirror image.
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, low = 1.0, 1.0 - (a + b) * x / (a + 1)
    low = 1.0 / (low if abs(low) > tiny else tiny)
    total = low
    for m in range(1, 200 + int(10 * math.sqrt(max(a, b)))):
        before = total
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            low, c = 1.0 + term * low, 1.0 + term / c
            low = 1.0 / (low if abs(low) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= low * c
        if abs(total - before) <= 1e-15 * abs(total):
            break
    return front * total


def at_least(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_cdf(k, n - k + 1, p)


def _rises_to(value, target: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (low, mid) if value(mid) >= target else (mid, high)
    return (low + high) / 2


def interval(k: int, n: int, level: float) -> tuple[float, float]:
    tail = (1 - level) / 2
    low = 0.0 if k <= 0 else _rises_to(lambda p: at_least(k, n, p), tail)
    return low, 1.0 if k >= n else _rises_to(lambda p: at_least(k + 1, n, p), 1 - tail)


def largest_rank(n: int, alpha: float, delta: float) -> int:
    low, high = 0, n + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if 1.0 - at_least(mid, n, alpha) <= delta else (low, mid)
    return low


def clopper_pearson(hits: Column | str, n: Column | str, level: float = 0.95) -> Column:
    """struct(low, high): the exact confidence interval of a share of ``hits`` in ``n``; NULL without any."""

    @F.pandas_udf("low double, high double")
    def every(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        rows = [interval(int(k), int(m), level) if m > 0 else (None, None) for k, m in zip(ks, ns)]
        return pd.DataFrame(rows, columns=["low", "high"], dtype="float64")

    return every(hits, n)


def order_rank(n: Column | str, alpha: float, delta: float) -> Column:
    """struct(rank, tail): the largest r with P(fewer than r of n fall below the alpha quantile) <= delta, and that chance.

    A threshold at the r-th smallest of n scores lies above their alpha quantile with probability at most delta. Rank 0
    with tail NULL where not even r = 1 holds.
    """

    @F.pandas_udf("rank long, tail double")
    def every(ns: pd.Series) -> pd.DataFrame:
        ranks = [largest_rank(int(m), alpha, delta) for m in ns]
        tails = [1.0 - at_least(r, int(m), alpha) if r else None for r, m in zip(ranks, ns)]
        return pd.DataFrame({"rank": ranks, "tail": pd.array(tails, dtype="float64")})

    return every(n)
