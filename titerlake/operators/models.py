"""Model fits per group in numpy, dealt out by Spark: catalytic models and LOWESS."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _fit_constant(age: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Rate and log likelihood of 1 - exp(-rate * age), by golden-section search."""
    def loglik(rate: float) -> float:
        p = np.clip(1 - np.exp(-rate * age), 1e-4, 1 - 1e-4)
        return float((x * np.log(p) + (n - x) * np.log(1 - p)).sum())

    low, high, g = 1e-4, 2.0, (5**0.5 - 1) / 2
    for _ in range(80):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (a, high) if loglik(a) < loglik(b) else (low, b)
    return (low + high) / 2, loglik((low + high) / 2)


def _fit_reversion(age, x, n, start: float) -> tuple[float, float, float]:
    """Rates of infection and reversion, by a shrinking grid around the best point."""
    best = (start, 1e-4, -np.inf)
    spread = (1.0, 0.2)
    for _ in range(10):
        for lam in np.clip(best[0] + spread[0] * np.linspace(-1, 1, 13), 1e-4, 2):
            for mu in np.clip(best[1] + spread[1] * np.linspace(-1, 1, 13), 1e-6, 1):
                p = np.clip(lam / (lam + mu) * (1 - np.exp(-(lam + mu) * age)), 1e-4, 1 - 1e-4)
                ll = float((x * np.log(p) + (n - x) * np.log(1 - p)).sum())
                if ll > best[2]:
                    best = (float(lam), float(mu), ll)
        spread = (spread[0] / 2, spread[1] / 2)
    return best


def catalytic_models(points: DataFrame) -> DataFrame:
    """Per disease (points are few: one row per age): the constant and the reversion model, AIC, the better one."""
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        age, x, n = (frame[c].to_numpy(float) for c in ("age", "x", "n"))
        lam, ll1 = _fit_constant(age, x, n)
        lam2, mu, ll2 = _fit_reversion(age, x, n, lam)
        aic1, aic2 = 2 - 2 * ll1, 4 - 2 * ll2
        return pd.DataFrame({"disease": [frame["disease"].iloc[0]], "n_points": [len(frame)], "foi_m1": [round(lam, 5)], "foi_m2": [round(lam2, 5)], "mu_m2": [round(mu, 5)], "aic_m1": [round(aic1, 3)], "aic_m2": [round(aic2, 3)], "recommended": ["M1" if aic1 <= aic2 else "M2"]})

    return points.groupBy("disease").applyInPandas(fit, "disease string, n_points long, foi_m1 double, foi_m2 double, mu_m2 double, aic_m1 double, aic_m2 double, recommended string")


def lowess(points: DataFrame, frac: float = 0.6) -> DataFrame:
    """Per group of ``key, x, y`` (few rows each): locally weighted lines with tricube weights."""
    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x", kind="stable")
        x, y = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
        k = min(len(x), max(2, int(np.ceil(frac * len(x)))))
        out = np.empty(len(x))
        for i, at in enumerate(x):
            d = np.abs(x - at)
            h = max(np.partition(d, k - 1)[k - 1], 1e-12)
            w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
            mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            var = (w * (x - mx) ** 2).sum()
            out[i] = my + ((w * (x - mx) * (y - my)).sum() / var if var > 1e-12 else 0.0) * (at - mx)
        return pd.DataFrame({"key": frame["key"], "x": x, "smooth": out.round(6)})

    return points.groupBy("key").applyInPandas(smooth, "key string, x double, smooth double")
