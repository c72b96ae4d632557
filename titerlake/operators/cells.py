"""Cells of an analysis: meta-merged positivity, concentration and counts of each group, and the tests between cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.functions import distributions, stats
from titerlake.operators import meta, summary


def cell_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each cell: ``rate`` with its interval, from the double-arcsine meta-analysis of its studies, or the weighted mean where
    there is none to merge (``method`` says which); the weighted mean as ``rate_weighted``; samples, points, and the
    geometric-mean concentration with its interval.

    Cells without positivity or without concentrations have nulls there. ``rows`` may hold both kinds of facts.
    """
    sero = summary.sero(rows)
    studies = sero.where(F.col("p").isNotNull()).withColumn("x", F.col("p") * F.col("n"))
    merged = meta.ft_meta(studies, keys).select(*keys, "k", "model", "i2", *[F.col(c).alias(f"m_{c}") for c in ("rate", "ci_lower", "ci_upper")])
    mine, other = F.col("data_type") == "seroprevalence", F.col("data_type") == "gmc"
    p, n = F.when(mine, stats.as_proportion(F.col("value"))), F.when(mine, F.col("sample_size").cast("double"))
    weighted = stats.weighted_rate(p, n)
    gmc = stats.gmc(F.when(other, F.col("value")), F.when(other, F.col("sample_size")))
    totals = rows.groupBy(*keys).agg(
        *[c.alias(f"w_{k}") for k, c in weighted.items()], *[c.alias(f"g_{k}") for k, c in gmc.items()], F.count("*").alias("n_points"),
    )
    # null keys are groups too
    both = totals.alias("t").join(merged.alias("m"), [F.col(f"t.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left")
    has = F.col("m_rate").isNotNull()
    return both.select(
        *[F.col(f"t.{k}").alias(k) for k in keys],
        *[F.when(has, F.col(f"m_{c}")).otherwise(F.col(f"w_{c}")).alias(c) for c in ("rate", "ci_lower", "ci_upper")],
        F.when(has, "meta").when(F.col("w_rate").isNotNull(), "weighted").alias("method"), "k", "model", "i2", F.col("w_rate").alias("rate_weighted"), F.col("w_total_sample").alias("total_sample"),
        F.col("g_gmc").alias("gmc"), F.col("g_ci_lower").alias("gmc_lower"), F.col("g_ci_upper").alias("gmc_upper"), F.col("g_n_values").alias("n_values"), "n_points",
    )


def trend_of_cells(cells: DataFrame, keys: list[str], year: str) -> DataFrame:
    """The weighted line through the cells' rates by year (weights are samples, 1 where there are none), with its p, and the
    trend statistic of their whole cases; that needs three years.
    """
    rows = cells.where(F.col("rate").isNotNull() & F.col(year).isNotNull())
    points = rows.select(*keys, F.col(year).cast("double").alias("x"), F.col("rate").alias("y"), F.when(F.col("total_sample") > 0, F.col("total_sample").cast("double")).otherwise(1.0).alias("w"))
    line = meta.trend_p_value(meta.weighted_trend(points.withColumn("x", F.col("x") - 2000), keys))
    cases = rows.where(F.col("total_sample") > 0).select(*keys, (F.col(year) - 2000).cast("double").alias("score"), F.bround(F.col("rate") * F.col("total_sample") / 100).alias("x"), F.col("total_sample").cast("double").alias("n"))
    steps = meta.cochran_armitage(cases, keys).select(*keys, "z")
    return line.join(steps, keys, "left")


def compared_cells(cells: DataFrame, key: str, first: str, second: str, keys: list[str]) -> DataFrame:
    """The two-sample test of the cells ``first`` and ``second`` of ``key``, in each group of ``keys`` that has both with samples."""
    def side(name: str, i: int) -> DataFrame:
        rows = cells.where((F.col(key) == name) & F.col("rate").isNotNull() & (F.col("total_sample") > 0))
        n = F.col("total_sample").cast("double")
        return rows.select(*keys, (F.col("rate") / 100 * n).alias(f"x{i}"), n.alias(f"n{i}"))

    pairs = side(first, 1).join(side(second, 2), keys)
    return meta.two_proportions(pairs)


def standardised(strata: DataFrame, keys: list[str], standard: dict[str, float], least: int = 3) -> DataFrame:
    """Directly standardised rates of ``keys, band, rate, n`` (rates as proportions): crude rate, rate, interval and error in percent.

    Bands without a weight or without people don't count; under ``least`` bands there is no rate.
    """
    total = sum(standard.values()) or 1.0
    weight = F.create_map(*[F.lit(v) for band, w in standard.items() for v in (band, w / total)])[F.col("band")]
    rows = strata.where((F.col("n") > 0) & F.col("rate").isNotNull()).withColumn("w", weight).where(F.col("w").isNotNull())
    r, n, w = F.col("rate"), F.col("n"), F.col("w")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n_strata"), (F.sum(r * n) / F.sum(n)).alias("c"), F.sum(w * r).alias("a"), F.sqrt(F.sum(w * w * r * (1 - r) / n)).alias("e"))
    enough, a, e = F.col("n_strata") >= least, F.col("a"), F.col("e")
    z = 1.959963984540054  # the two-sided 95 percent point
    out = {"crude": F.col("c"), "asr": a, "ci_lower": a - z * e, "ci_upper": a + z * e, "error": e}
    return sums.select(*keys, "n_strata", *[F.when(enough, F.round(c * 100, 4)).alias(name) for name, c in out.items()])


def binomial_interval(x: Column, n: Column, enough: int = 30) -> tuple[Column, Column, Column]:
    """Lower and upper bound of a proportion and the method: Wilson from ``enough`` people on, exact below, null without any."""
    low, high = stats.wilson(x / n, n)
    exact = distributions.exact_interval(F.when(n < enough, x), F.when(n < enough, n))
    large = n >= enough
    method = F.when(large, "wilson").when(n > 0, "exact")
    return F.when(large, low).otherwise(exact["lower"]), F.when(large, high).otherwise(exact["upper"]), method
