"""Meta-analysis and trend tests as one or two dependent aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerlake.functions import stats
from titerlake.functions.distributions import t_p_value


def _counted(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Distinct values of each group and how many rows have them, as ``m``. What follows reads this small exchange, not the rows again."""
    return rows.groupBy(*keys, *values).agg(F.count("*").cast("double").alias("m"))


def ft_meta(studies: DataFrame, keys: list[str]) -> DataFrame:
    """Double-arcsine meta-analysis of ``x`` positives among ``n``: fixed, or random effects where studies differ.

    Q, tau and the fixed pool follow from sums of powers of weights; the random pool needs one more pass, over the
    counted studies with tau joined back. Q is summed from values centred at the group's mean.
    """
    w, t = F.col("n") + 0.5, stats.ft_transform(F.col("x"), F.col("n"))
    rows = _counted(studies.where(F.col("n") > 0), keys, "x", "n").withColumns({"w": w, "t": t})
    m, w, t = F.col("m"), F.col("w"), F.col("t")
    first = rows.groupBy(*keys).agg(F.sum(m).cast("long").alias("k"), F.sum(m * w).alias("sw"), F.sum(m * w * w).alias("sww"), F.sum(m * w * t).alias("swt"), F.sum(m * w * t * t).alias("swtt"), (F.sum(m) / F.sum(m / F.col("n"))).alias("nh"))
    first = first.withColumn("fixed", F.col("swt") / F.col("sw")).withColumn("q", F.greatest(F.col("swtt") - F.col("swt") * F.col("fixed"), F.lit(0.0)))
    df = F.col("k") - 1
    first = first.withColumns({
        "i2": F.when(F.col("q") > df, (F.col("q") - df) / F.col("q") * 100).otherwise(0.0),
        "tau2": F.greatest(F.coalesce(F.try_divide(F.col("q") - df, F.col("sw") - F.col("sww") / F.col("sw")), F.lit(0.0)), F.lit(0.0)),
    })
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    random = rows.alias("r").join(first.select(*keys, "tau2").alias("f"), same).select(*[F.col(f"r.{k}").alias(k) for k in keys], "m", "t", (1 / (1 / F.col("w") + F.col("tau2"))).alias("rw"))
    random = random.groupBy(*keys).agg(F.sum(F.col("m") * F.col("rw")).alias("srw"), F.sum(F.col("m") * F.col("rw") * F.col("t")).alias("srwt"))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    pooled = first.alias("f").join(random.alias("r"), same).select("f.*", "srw", "srwt")
    apart = (F.col("k") > 1) & ((F.col("i2") > 50) | (F.col("q") > stats.chi2_90(F.greatest(df, F.lit(1)).cast("double"))))
    mean, se = F.when(apart, F.col("srwt") / F.col("srw")).otherwise(F.col("fixed")), F.when(apart, 1 / F.sqrt("srw")).otherwise(1 / F.sqrt("sw"))

    def percent(x):
        return F.round(stats.ft_inverse(x, F.col("nh")) * 100, 2)

    return pooled.select(
        *keys, "k", F.round("q", 4).alias("q"), F.round("i2", 2).alias("i2"), F.round("tau2", 6).alias("tau2"), F.when(apart, "random").otherwise("fixed").alias("model"),
        percent(mean).alias("rate"), percent(mean - stats.Z * se).alias("ci_lower"), percent(mean + stats.Z * se).alias("ci_upper"),
    )


def q_between(studies: DataFrame, key: str) -> DataFrame:
    """Total, within-group and between-group heterogeneity of double-arcsine values."""
    w, t = F.col("n") + 0.5, stats.ft_transform(F.col("x"), F.col("n"))
    rows = studies.where(F.col("n") > 0).select(key, w.alias("w"), t.alias("t"))
    sums = rows.groupBy(key).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("t")).alias("swt"), F.sum(F.col("w") * F.col("t") * F.col("t")).alias("swtt"))
    within = F.sum(F.col("swtt") - F.col("swt") * F.col("swt") / F.col("sw"))
    total = F.sum("swtt") - F.sum("swt") * F.sum("swt") / F.sum("sw")
    return sums.agg(F.round(total, 4).alias("q_total"), F.round(within, 4).alias("q_within"), F.round(F.greatest(total - within, F.lit(0.0)), 4).alias("q_between"), (F.count("*") - 1).alias("df"))


def inverse_variance(studies: DataFrame, keys: list[str]) -> DataFrame:
    """Fixed and random pools of proportions ``p`` among ``n``; the variance is corrected at 0 and 1, p itself is not."""
    edge = F.col("p").isin(0.0, 1.0)
    p2 = F.when(edge, (F.col("p") * F.col("n") + 0.5) / (F.col("n") + 1)).otherwise(F.col("p"))
    var = p2 * (1 - p2) / F.when(edge, F.col("n") + 1).otherwise(F.col("n"))
    counted = _counted(studies.where((F.col("n") > 0) & F.col("p").isNotNull()), keys, "p", "n")
    rows = counted.withColumn("v", var).where(F.col("v") > 0).withColumn("w", 1 / F.col("v"))
    m = F.col("m")
    first = rows.groupBy(*keys).agg(
        F.sum(m).cast("long").alias("k"), F.sum(m * F.col("w")).alias("sw"), F.sum(m * F.col("w") * F.col("w")).alias("sww"), F.sum(m * F.col("w") * F.col("p")).alias("swp"), F.sum(m * F.col("w") * F.col("p") * F.col("p")).alias("swpp")
    )
    q, df = F.greatest(F.col("swpp") - F.col("swp") * F.col("swp") / F.col("sw"), F.lit(0.0)), F.col("k") - 1
    first = first.withColumn("q", q).withColumns({
        "i2": F.when(F.col("q") > df, (F.col("q") - df) / F.col("q") * 100).otherwise(0.0),
        "tau2": F.greatest(F.coalesce(F.try_divide(F.col("q") - df, F.col("sw") - F.col("sww") / F.col("sw")), F.lit(0.0)), F.lit(0.0)),
    })
    random = rows.join(first.select(*keys, "tau2"), keys).withColumn("rw", 1 / (F.col("v") + F.col("tau2")))
    random = random.groupBy(*keys).agg((F.sum(m * F.col("rw") * F.col("p")) / F.sum(m * F.col("rw"))).alias("random"))
    label = F.when(F.col("i2") < 25, "low").when(F.col("i2") < 50, "moderate").otherwise("high")
    return first.join(random, keys).select(
        *keys, "k", F.round(F.col("swp") / F.col("sw"), 6).alias("fixed"), F.round("random", 6).alias("random"), F.round("q", 4).alias("q"), F.round("i2", 2).alias("i2"), F.round("tau2", 6).alias("tau2"), label.alias("heterogeneity")
    )


def weighted_trend(points: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted least squares of ``y`` on ``x`` with weight ``w``, from one pass of sums of centred values."""
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    s = points.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy")
    )
    cxx, cxy, cyy = (F.col(a) - F.col(b) * F.col(c) / F.col("sw") for a, b, c in (("sxx", "sx", "sx"), ("sxy", "sx", "sy"), ("syy", "sy", "sy")))
    slope = F.when((F.col("k") >= 2) & (F.abs(cxx) > 1e-9), cxy / cxx).otherwise(F.when(F.col("k") >= 2, 0.0))
    r2 = F.when((F.abs(cxx) > 1e-9) & (cyy > 1e-9), cxy * cxy / (cxx * cyy))
    way = F.when(slope > 1e-9, "up").when(slope < -1e-9, "down").when(slope.isNotNull(), "flat")
    return s.select(*keys, "k", F.round(slope, 6).alias("slope"), F.round(r2, 6).alias("r2"), way.alias("direction"))


def trend_p_value(trends: DataFrame) -> DataFrame:
    """``p`` of the slopes of ``weighted_trend``: t of k - 2 degrees of freedom from r2; null without any."""
    df = (F.col("k") - 2).cast("double")
    t = F.when((df > 0) & (F.col("r2") < 1), F.sqrt(F.col("r2") * df / (1 - F.col("r2"))))
    return trends.withColumn("p", F.round(t_p_value(t, df), 6))


def pooled_wilson(studies: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse-variance pool of proportions ``p`` among ``n`` (0 and 1 with half a case more) and its Wilson interval over all people."""
    edge = F.col("p").isin(0.0, 1.0)
    p = F.when(edge, (F.col("p") * F.col("n") + 0.5) / (F.col("n") + 1)).otherwise(F.col("p"))
    n = F.when(edge, F.col("n") + 1).otherwise(F.col("n"))
    rows = studies.where((F.col("n") > 0) & F.col("p").isNotNull()).withColumns({"w": n / (p * (1 - p)), "wp": n / (1 - p), "m": F.col("n")})
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n_studies"), F.sum("m").alias("total"), (F.sum("wp") / F.sum("w")).alias("pool"))
    low, high = stats.wilson(F.col("pool"), F.col("total"))
    return sums.select(*keys, "n_studies", F.round("pool", 6).alias("pooled"), F.round(low, 6).alias("ci_lower"), F.round(high, 6).alias("ci_upper"))


def study_weights(studies: DataFrame, keys: list[str]) -> DataFrame:
    """Each study's share of its group's inverse-variance weight, in percent."""
    rows = studies.where((F.col("n") > 0) & (F.col("p") > 0) & (F.col("p") < 1)).withColumn("w", F.col("n") / (F.col("p") * (1 - F.col("p"))))
    total = rows.groupBy(*keys).agg(F.sum("w").alias("all"))
    return rows.join(total, keys).withColumn("weight", F.round(F.col("w") / F.col("all") * 100, 6))


def cochran_armitage(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Trend statistic over ``score`` groups with ``x`` of ``n``; null under three groups or without variation."""
    n, x, s = F.col("n"), F.col("x"), F.col("score")
    t = groups.groupBy(*keys).agg(F.count("*").alias("k"), F.sum(n).alias("sn"), F.sum(x).alias("sx"), F.sum(n * s).alias("sns"), F.sum(n * s * s).alias("snss"), F.sum(x * s).alias("sxs"))
    p = F.col("sx") / F.col("sn")
    var = p * (1 - p) * (F.col("snss") - F.col("sns") * F.col("sns") / F.col("sn"))
    z = F.when((F.col("k") >= 3) & (var > 0), (F.col("sxs") - p * F.col("sns")) / F.sqrt(F.greatest(var, F.lit(0.0))))
    return t.select(*keys, "k", F.round(z, 4).alias("z"))


def two_proportions(pairs: DataFrame) -> DataFrame:
    """Pooled z, risk difference and ratio of ``x1/n1`` and ``x2/n2`` with 95 percent intervals.

    An arm at 0 or full gets half a case and one person more.
    """
    def arm(x, n):
        edge = (x == 0) | (x == n)
        return F.when(edge, x + 0.5).otherwise(x), F.when(edge, n + 1).otherwise(n)

    (x1, n1), (x2, n2) = arm(F.col("x1"), F.col("n1")), arm(F.col("x2"), F.col("n2"))
    p1, p2, p = x1 / n1, x2 / n2, (x1 + x2) / (n1 + n2)
    z = (p1 - p2) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    apart, ratio = stats.Z * F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), stats.Z * F.sqrt(1 / x1 - 1 / n1 + 1 / x2 - 1 / n2)
    return pairs.withColumns({
        "z": F.round(z, 4), "rd": F.round(p1 - p2, 4), "rd_lower": F.round(F.greatest(p1 - p2 - apart, F.lit(-1.0)), 4), "rd_upper": F.round(F.least(p1 - p2 + apart, F.lit(1.0)), 4),
        "rr": F.round(p1 / p2, 4), "rr_lower": F.round(F.exp(F.ln(p1 / p2) - ratio), 4), "rr_upper": F.round(F.exp(F.ln(p1 / p2) + ratio), 4),
    })


def egger(studies: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Intercept test of small-study effects: double-arcsine values on the root of n, weighted by 1/se.

    One pass of weighted moments. Under ``least`` studies there is no test; under three, or without spread, no p.
    """
    t, s = stats.ft_transform(F.col("x"), F.col("n")), F.sqrt("n")
    rows = studies.where((F.col("n") > 0) & F.col("x").isNotNull()).select(*keys, t.alias("t"), s.alias("s"), F.sqrt(F.col("n") + 0.5).alias("w"))
    w, t, s = F.col("w"), F.col("t"), F.col("s")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum(w).alias("sw"), (F.sum(w * t) / F.sum(w)).alias("mt"), (F.sum(w * s) / F.sum(w)).alias("ms"),
        F.sum(w * t * s).alias("wts"), F.sum(w * s * s).alias("wss"), F.sum(w * t * t).alias("wtt"),
    )
    sums = sums.withColumns({"cov": F.col("wts") / F.col("sw") - F.col("mt") * F.col("ms"), "var": F.col("wss") / F.col("sw") - F.col("ms") * F.col("ms"), "spread": F.col("wtt") / F.col("sw") - F.col("mt") * F.col("mt")})
    tested = (F.col("k") >= least) & (F.col("var") > 1e-12)
    sums = sums.withColumn("slope", F.when(tested, F.try_divide("cov", "var"))).withColumn("a", F.col("mt") - F.col("slope") * F.col("ms"))
    mse = F.try_divide(F.col("sw") * (F.col("spread") - F.col("slope") * F.col("cov")), F.when(F.col("k") > 2, F.col("k") - 2))
    error = F.when(mse > 0, F.sqrt(mse * (1 / F.col("sw") + F.try_divide(F.col("ms") * F.col("ms"), F.col("sw") * F.col("var")))))
    sums = sums.withColumn("e", error).withColumn("ratio", F.when(F.col("e") >= 1e-12, F.col("a") / F.col("e")))
    p = t_p_value(F.col("ratio"), (F.col("k") - 2).cast("double"))
    return sums.select(*keys, "k", F.round("a", 4).alias("intercept"), F.round("slope", 6).alias("slope"), F.round("e", 6).alias("error"), F.round("ratio", 4).alias("t"), F.round(p, 6).alias("p_value"))
