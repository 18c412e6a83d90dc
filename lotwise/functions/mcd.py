"""Minimum covariance determinant of one bounded sample, and chi-square tails, for Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lotwise import constants as K

STEPS = 30


def chi2_sf(x: float, df: int) -> float:
    """Upper tail by the recurrence over degrees of freedom."""
    if not x > 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        total, term = math.exp(-half), math.exp(-half)
        for j in range(1, df // 2):
            term *= half / j
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for j in range(df // 2):
        total += term
        term *= half / (j + 1.5)
    return min(1.0, total)


def chi2_isf(p: float, df: int) -> float:
    low, high = 0.0, 10.0 * df + 100.0
    for _ in range(200):
        mid = (low + high) / 2
        if chi2_sf(mid, df) > p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def chi2_tail(x: Column | str, df: int) -> Column:
    """Upper chi-square tail of a column: a finite sum for an even number of degrees of freedom, else an Arrow batch."""
    if df % 2 == 0:
        x = F.col(x) if isinstance(x, str) else x
        half, factorial, total = x / 2, 1.0, F.lit(1.0)
        for j in range(1, df // 2):
            factorial *= j
            total = total + F.pow(half, F.lit(float(j))) / F.lit(factorial)
        return F.when(x.isNull() | F.isnan(x), None).when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.exp(-half) * total))

    @F.pandas_udf(DoubleType())
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: chi2_sf(v, df) if v == v else None)

    return tail(x)


def inverse(flat: Column | str) -> Column:
    """Symmetric inverse of a row-major covariance; NULL when singular or ill-conditioned."""

    # Made here, not at module level: a used UDF holds a handle of the driver's JVM and can't travel with its module.
    @F.pandas_udf(ArrayType(DoubleType()))
    def every(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else invert(v))

    return every(flat)


def invert(values) -> np.ndarray | None:
    a = np.asarray(values, dtype=np.float64)
    p = math.isqrt(a.size)
    a = a.reshape(p, p)
    scale = np.sqrt(np.diag(a))
    if not np.all(np.isfinite(a)) or np.any(scale == 0):
        return None
    r = a / np.outer(scale, scale)
    if not np.linalg.cond(r) <= K.MCD_CONDITION:
        return None
    inv = np.linalg.inv(r)
    return ((inv + inv.T) / 2 / np.outer(scale, scale)).ravel()


def _distances(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    delta = x - centre
    return np.einsum("ij,ij->i", delta, np.linalg.solve(cov, delta.T).T)


def fit(x: np.ndarray, support: float = K.MCD_SUPPORT):
    """(refusal, location, covariance) of the rows of ``x``.

    Starts from the rows nearest to the median in MAD units, keeps the h nearest rows until they stop changing,
    scales the covariance by the median distance, and refits on the rows inside the 97.5 % ellipsoid.
    """
    n, p = x.shape
    if n < K.MIN_COHORT or n <= p:
        return "INSUFFICIENT_COHORT", None, None
    if n < K.MCD_SAMPLE_FACTOR * p:
        return "INSUFFICIENT_SAMPLE_RATIO", None, None
    if np.all(x == x[0]):
        return "NO_VARIATION", None, None
    std = x.std(axis=0)
    if np.any(std == 0):
        return "SINGULAR_COVARIANCE", None, None
    y = x / std
    y = y[np.lexsort(y.T[::-1])]
    h = math.ceil(support * n)
    med = np.median(y, axis=0)
    mad = np.median(np.abs(y - med), axis=0)
    mad[mad == 0] = 1.0
    keep = np.argsort((((y - med) / mad) ** 2).sum(axis=1), kind="stable")[:h]
    try:
        for _ in range(STEPS):
            centre, cov = y[keep].mean(axis=0), np.cov(y[keep].T, bias=True).reshape(p, p)
            new = np.argsort(_distances(y, centre, cov), kind="stable")[:h]
            if np.array_equal(np.sort(new), np.sort(keep)):
                break
            keep = new
        dist = _distances(y, centre, cov)
        factor = np.median(dist) / chi2_isf(0.5, p)
        inside = dist / factor < chi2_isf(0.025, p)
        centre, cov = y[inside].mean(axis=0), np.cov(y[inside].T, bias=True).reshape(p, p)
        if not np.linalg.cond(cov) <= K.MCD_CONDITION:
            return "SINGULAR_COVARIANCE", None, None
    except np.linalg.LinAlgError:
        return "SINGULAR_COVARIANCE", None, None
    return None, centre * std, cov * np.outer(std, std)
