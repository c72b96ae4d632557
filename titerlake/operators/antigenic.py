"""Antigenic maps: metric scaling from many random starts, dealt out by Spark, and how two maps compare."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STARTS, STEPS, ENOUGH = 20, 1000, 1e-8
_MAP = "start int, stress_raw double, stress double, steps int, converged boolean, points array<struct<kind: string, name: string, x: double, y: double, stress: double>>"


def joint_distances(table: np.ndarray) -> np.ndarray:
    """All distances among antigens (rows), sera (columns) and between both, of a table of antigen-serum distances."""
    def apart(rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))

    return np.block([[apart(table), table], [table.T, apart(table.T)]])


def scaled(distances: np.ndarray, rng: np.random.Generator, steps: int = STEPS, enough: float = ENOUGH) -> tuple[np.ndarray, float, int, bool]:
    """Coordinates in the plane by majorisation, their raw stress, the steps taken, and whether they settled."""
    n = len(distances)
    at = rng.uniform(-1, 1, (n, 2)) * max(float(distances.max()), 1e-9)
    before = np.inf
    for step in range(1, steps + 1):
        apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
        stress = float(((distances - apart) ** 2).sum() / 2)
        if before - stress < enough * max(stress, 1e-12):
            return at, stress, step, True
        before = stress
        pull = np.where(apart > 1e-12, -distances / np.where(apart > 1e-12, apart, 1), 0.0)
        np.fill_diagonal(pull, 0.0)
        np.fill_diagonal(pull, -pull.sum(1))
        at = pull @ at / n
    return at, stress, steps, False


def antigenic_maps(distances: DataFrame, keys: list[str], starts: int = STARTS, seed: int = 0) -> DataFrame:
    """The map of least stress of each group of ``keys, antigen, serum, distance``: stress, and every point with its share.

    Each start of each group is a task's row; a group is one table of titers, so small. Antigens without a distance to one
    of the sera are left out, as those with a titer at the limit are before. Maps are turned so that the first axis is the
    longer one and the first point lies on the positive sides.
    """
    named = distances.groupBy(*keys).agg(F.collect_list(F.struct(F.col("antigen").cast("string").alias("antigen"), F.col("serum").cast("string").alias("serum"), "distance")).alias("cells"))
    each = named.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).repartition(*keys, "start")

    @F.pandas_udf(_MAP)
    def maps(cells: pd.Series, start: pd.Series) -> pd.DataFrame:
        rows = []
        for cell, number in zip(cells, start, strict=True):
            table = pd.DataFrame([dict(c) for c in cell]).pivot(index="antigen", columns="serum", values="distance").sort_index().sort_index(axis=1).dropna()
            wanted = joint_distances(table.to_numpy(float))
            at, raw, steps, settled = scaled(wanted, np.random.default_rng([seed, number]))
            at = oriented(at)
            share = ((wanted - np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))) ** 2).sum(1)
            whole = float((wanted**2).sum() / 2)
            kinds = [("antigen", a) for a in table.index] + [("serum", s) for s in table.columns]
            points = [{"kind": k, "name": m, "x": float(x), "y": float(y), "stress": float(s)} for (k, m), (x, y), s in zip(kinds, at, share, strict=True)]
            rows.append((number, raw, float(np.sqrt(raw / whole)) if whole else 0.0, steps, settled, points))
        return pd.DataFrame(rows, columns=["start", "stress_raw", "stress", "steps", "converged", "points"])

    made = each.select(*keys, maps("cells", "start").alias("map"))
    best = made.groupBy(*keys).agg(F.min_by("map", F.struct(F.round("map.stress_raw", 9), "map.start")).alias("map"))
    return best.select(*keys, "map.*")


def oriented(at: np.ndarray) -> np.ndarray:
    """Centred, the longer axis first, signs so that the first point off an axis is positive there."""
    at = at - at.mean(0)
    if len(at) > 1:
        at = at @ np.linalg.svd(at, full_matrices=False)[2].T
    for axis in range(at.shape[1]):
        off = at[np.abs(at[:, axis]) > 1e-9, axis]
        if len(off) and off[0] < 0:
            at[:, axis] = -at[:, axis]
    return at


def procrustes(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """What is left between two maps of the same points after moving, scaling and turning (0 to 1), and the distance of each point."""
    a, b = a - a.mean(0), b - b.mean(0)
    size_a, size_b = np.linalg.norm(a), np.linalg.norm(b)
    if size_a == 0 or size_b == 0:
        return float("nan"), np.full(len(a), np.nan)
    a, b = a / size_a, b / size_b
    left, size, right = np.linalg.svd(a.T @ b)
    fitted = b @ (left @ right).T * size.sum()
    return float(((a - fitted) ** 2).sum()), np.sqrt(((a - fitted) ** 2).sum(1))


def compared_maps(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Of the points both maps of a group have: how many, what alignment leaves, and ``1 - rest**2`` as their likeness.

    Fewer than three common points compare with nothing.
    """
    def points(maps: DataFrame, side: str) -> DataFrame:
        return maps.select(*keys, F.explode("points").alias("p")).select(*keys, "p.kind", "p.name", F.array("p.x", "p.y").alias(side))

    both = points(first, "a").join(points(second, "b"), [*keys, "kind", "name"])
    groups = both.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "name", "a", "b"))).alias("pairs"))

    @F.pandas_udf("double")
    def rest(pairs: pd.Series) -> pd.Series:
        out = []
        for p in pairs:
            a, b = (np.array([r[side] for r in p], float) for side in "ab")
            left = procrustes(a, b)[0] if len(p) >= 3 else np.nan
            out.append(None if np.isnan(left) else left)
        return pd.Series(out, dtype="float64")

    left = rest("pairs")
    return groups.select(*keys, F.size("pairs").alias("n_common"), left.alias("d")).select(*keys, "n_common", F.round("d", 6).alias("rest"), F.round(1 - F.col("d") * F.col("d"), 6).alias("likeness"))
