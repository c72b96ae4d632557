"""Penalised B-spline curves of positivity by age, and the force of infection that follows from them.

Spark sums the rows to points of a tenth of a year (at most some 1300 of them a group), deals every group with every penalty
to its tasks, and keeps the penalty of the least cross-validation score; a task solves systems of as many unknowns
as there are basis functions, at most twelve.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerlake.functions.stats import Z

#: Penalties tried: twelve from 1e-3 to 1e2, evenly in the logarithm.
PENALTIES = [float(10 ** (-3 + 5 * k / 11)) for k in range(12)]
_FIT = "penalty double, score double, freedom double, knots array<double>, beta array<double>, covariance array<double>"


def knots_of(ages: np.ndarray) -> np.ndarray:
    """Three to eight inner knots evenly over the ages, the ends four times."""
    low, high = float(ages.min()), float(ages.max())
    if high - low < 1e-9:
        high = low + 1.0
    inner = np.linspace(low, high, min(8, max(3, len(ages) // 3)) + 2)[1:-1]
    return np.concatenate([[low] * 4, inner, [high] * 4])


def basis(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """Values of all B-splines at ``x`` (rows), by the recursion over degrees; the last knot belongs to the last span."""
    x = np.asarray(x, float)[:, None]
    inside = (knots[:-1] <= x) & (x < knots[1:])
    last = np.flatnonzero(knots[:-1] < knots[1:])[-1]
    inside[(x >= knots[-1])[:, 0]] = False
    inside[(x >= knots[-1])[:, 0], last] = True
    out = inside.astype(float)
    for d in range(1, degree + 1):
        n = len(knots) - d - 1
        left, right = knots[d : d + n] - knots[:n], knots[d + 1 : d + 1 + n] - knots[1 : 1 + n]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(left > 0, (x - knots[:n]) / left, 0.0)
            b = np.where(right > 0, (knots[d + 1 : d + 1 + n] - x) / right, 0.0)
        out = a * out[:, :n] + b * out[:, 1 : n + 1]
    return out


def _logistic(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -30, 30)))


def fit_points(ages: np.ndarray, x: np.ndarray, n: np.ndarray, penalty: float) -> dict:
    """Newton steps for the penalised binomial likelihood, halved where they would worsen it."""
    knots = knots_of(ages)
    b, y = basis(ages, knots), np.clip(x / n, 1e-4, 1 - 1e-4)
    bend = np.diff(np.eye(b.shape[1]), 2, axis=0)
    bend = penalty * bend.T @ bend

    def loss(beta: np.ndarray) -> float:
        p = _logistic(b @ beta)
        return -float((n * (y * np.log(p) + (1 - y) * np.log1p(-p))).sum()) + 0.5 * float(beta @ bend @ beta)

    beta = np.zeros(b.shape[1])
    now = loss(beta)
    for _ in range(60):
        p = _logistic(b @ beta)
        curve = (b * (n * p * (1 - p))[:, None]).T @ b + bend
        step = np.linalg.lstsq(curve, b.T @ (n * (y - p)) - bend @ beta, rcond=None)[0]
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > now:
            size /= 2
        if size <= 1e-6:
            break
        beta = beta + size * step
        now, before = loss(beta), now
        if before - now < 1e-10 * (1 + abs(now)):
            break
    p = _logistic(b @ beta)
    part = (b * (n * p * (1 - p))[:, None]).T @ b
    inverse = np.linalg.pinv(part + bend)
    freedom = float(np.trace(inverse @ part))
    room = (1 - freedom / len(ages)) ** 2
    score = float((n * (y - p) ** 2).sum()) / room if room > 1e-12 else float("inf")
    return {"penalty": penalty, "score": score, "freedom": freedom, "knots": knots.tolist(), "beta": beta.tolist(), "covariance": inverse.ravel().tolist()}


def _fits(points: pd.Series, penalties: pd.Series) -> pd.DataFrame:
    rows = []
    for point, penalty in zip(points, penalties, strict=True):
        ages, x, n = np.array([(r["age"], r["x"], r["n"]) for r in point], float).T
        rows.append(fit_points(ages, x, n, penalty))
    return pd.DataFrame(rows, columns=["penalty", "score", "freedom", "knots", "beta", "covariance"])


_CURVE = "array<struct<age: double, prevalence: double, ci_lower: double, ci_upper: double, force: double>>"


def curve_at(grid: np.ndarray, knots: np.ndarray, beta: np.ndarray, covariance: np.ndarray) -> list[tuple]:
    """Age, percent with its band, and force of infection; no force where nearly all are positive, none below zero."""
    b = basis(grid, knots)
    eta, se = b @ beta, np.sqrt(np.maximum(((b @ covariance) * b).sum(1), 0))
    gaps = knots[4 : 3 + len(beta)] - knots[1 : len(beta)]
    slope = basis(grid, knots[1:-1], 2) @ (3 * np.diff(beta) / np.where(gaps > 0, gaps, 1))
    p = _logistic(eta)
    force = np.maximum(p * slope, 0)
    return [
        (float(a), *(round(float(v) * 100, 2) for v in (q, low, high)), None if q >= 0.999 else round(float(f), 6))
        for a, q, low, high, f in zip(grid, p, _logistic(eta - Z * se), _logistic(eta + Z * se), force, strict=True)
    ]


def _curves(fit: pd.DataFrame) -> pd.Series:
    out = []
    for knots, beta, covariance in zip(fit["knots"], fit["beta"], fit["covariance"], strict=True):
        knots, beta = np.asarray(knots, float), np.asarray(beta, float)
        grid = np.arange(np.ceil(knots[0] * 2) / 2, np.floor(knots[-1] * 2) / 2 + 1e-9, 0.5)
        if not len(grid) or grid[-1] < knots[-1] - 1e-9:
            grid = np.append(grid, knots[-1])
        made = curve_at(grid, knots, beta, np.asarray(covariance, float).reshape(len(beta), -1))
        out.append([dict(zip(("age", "prevalence", "ci_lower", "ci_upper", "force"), r, strict=True)) for r in made])
    return pd.Series(out)


def age_curves(points: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """The fitted curve of each group of ``keys, age, x, n`` with ``least`` ages or more.

    ``penalty`` and ``freedom`` are those of the best cross-validation score; ``curve`` has a value every half year;
    ``falls`` says whether it drops by more than half a percent in a step, ``sparse`` whether ages lie over ten years apart.
    """
    order = F.array_sort(F.collect_list(F.struct("age", "x", "n")))
    groups = points.where(F.col("n") > 0).groupBy(*keys).agg(order.alias("points")).where(F.size("points") >= least)
    fits, made_curves = F.pandas_udf(_fits, _FIT), F.pandas_udf(_curves, _CURVE)
    each = groups.withColumn("penalty", F.explode(F.array(*map(F.lit, PENALTIES)))).repartition(*keys, "penalty")
    best = each.select(*keys, "points", fits("points", "penalty").alias("fit")).groupBy(*keys).agg(F.min_by("fit", F.struct("fit.score", "fit.penalty")).alias("fit"), F.first("points").alias("points"))
    made = best.select(*keys, "points", "fit", made_curves("fit").alias("curve"))
    steps = F.zip_with(F.slice("curve", 2, F.size("curve")), F.slice("curve", 1, F.greatest(F.size("curve") - 1, F.lit(0))), lambda b, a: b["prevalence"] - a["prevalence"])
    gaps = F.zip_with(F.slice("points", 2, F.size("points")), F.slice("points", 1, F.size("points") - 1), lambda b, a: b["age"] - a["age"])
    return made.select(
        *keys, F.size("points").alias("n_ages"), F.round("fit.penalty", 6).alias("penalty"), F.round("fit.freedom", 3).alias("freedom"),
        F.exists(steps, lambda s: s < -0.5).alias("falls"), F.exists(gaps, lambda g: g > 10).alias("sparse"), "curve",
    )
