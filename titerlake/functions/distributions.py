"""Distributions that Spark has no function for: incomplete beta, t, exact binomial; numpy, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised I_x(a, b) by its continued fraction (modified Lentz), all elements at once."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inside = (x > 0) & (x < 1)
    safe = np.where(inside, x, 0.5)
    swap = safe >= (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - safe, safe)
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    fraction = d.copy()
    for m in range(1, 300):
        for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            fraction = fraction * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    value = np.where(swap, 1 - front * fraction, front * fraction)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def t_two_sided(t, df) -> np.ndarray:
    """P(abs(T) >= abs(t)); nan without degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = (df > 0) & np.isfinite(t)
    safe = np.where(ok, df, 1.0)
    return np.where(ok, incomplete_beta(safe / 2, 0.5, safe / (safe + np.where(ok, t, 0) ** 2)), np.nan)


def _bisect(f, low: float, high: float) -> float:
    """Where the falling ``f`` is 0."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


#: The 95 percent points of t for 1 to 30 degrees of freedom, to three places.
T_CRITICAL = {df: round(_bisect(lambda t, df=df: float(t_two_sided(t, df)) - 0.05, 0, 50), 3) for df in range(1, 31)}


def _clopper_pearson_all(x: np.ndarray, n: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The exact interval of each pair of arrays, all bisected at once until no bound moves."""

    def halved(above) -> np.ndarray:
        low, high = np.zeros(len(x)), np.ones(len(x))
        for _ in range(200):
            mid = (low + high) / 2
            if np.all((mid == low) | (mid == high)):
                break
            up = above(mid)
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        return (low + high) / 2

    some, rest = np.where(x > 0, x, 1.0), np.where(x < n, n - x, 1.0)
    low = halved(lambda p: incomplete_beta(some, n - some + 1, p) < alpha / 2)
    high = halved(lambda p: 1 - incomplete_beta(x + 1, rest, p) > alpha / 2)
    return np.where(x <= 0, 0.0, low), np.where(x >= n, 1.0, high)


def clopper_pearson(x: float, n: float, alpha: float = 0.05) -> tuple[float, float]:
    """The exact binomial interval."""
    low, high = _clopper_pearson_all(np.array([float(x)]), np.array([float(n)]), alpha)
    return float(low[0]), float(high[0])


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df)).where(lambda p: p.notna(), None)


@pandas_udf(StructType([StructField("lower", DoubleType()), StructField("upper", DoubleType())]))
def exact_interval(x: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Clopper-Pearson bounds of ``x`` among ``n``; null for none of them. Equal pairs of a batch are computed once."""
    pairs = np.column_stack([x.to_numpy(float), n.to_numpy(float)])
    known = (pairs[:, 1] > 0) & (pairs[:, 0] >= 0) & (pairs[:, 0] <= pairs[:, 1])
    bounds = np.full(pairs.shape, np.nan)
    if known.any():
        each, place = np.unique(pairs[known], axis=0, return_inverse=True)
        bounds[known] = np.column_stack(_clopper_pearson_all(each[:, 0], each[:, 1], 0.05))[place.ravel()]
    return pd.DataFrame(bounds, columns=["lower", "upper"])
