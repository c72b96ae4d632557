"""Catalytic models of infection by age, fitted for all groups at once.

Every group, model and change point is a row of parameters. A coarse grid of starts is scored by its likelihood and the best
one kept; then each round joins the parameters to the group's ages, sums score and expected information, and takes a Fisher
step, halved towards the best point so far where the likelihood fell. All of it is joins and sums; no group is
fitted in Python. The information of the last round gives the intervals.

The models: constant force ``1 - exp(-a l)``; reversion ``l/(l + m) (1 - exp(-(l + m) a))``, with m free or given; and two
phases ``1 - exp(-(l1 min(a, c) + l2 max(0, a - c)))`` with the change point c taken from ``CHANGE_POINTS``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titerlake.functions.stats import Z, erf
from titerlake.sources.shared import Tables

#: Ages at which the second phase may begin, and the bounds of positivity and rates (fixed values).
CHANGE_POINTS = (2, 3, 5, 8, 12, 18, 25, 35)
EDGE, LEAST_RATE, MOST_RATE = 1e-4, 1e-9, 5.0
_START_RATES, _START_REVERSIONS = (0.005, 0.02, 0.05, 0.1, 0.2, 0.5), (0.001, 0.01, 0.05, 0.2)
ROUNDS = 14


def age_points(rows: DataFrame, keys: list[str], age: Column, p: Column, n: Column) -> DataFrame:
    """``keys, age, x, n``: cases and people of each midpoint to a tenth of a year; without age, rate or people a row drops out."""
    ok = age.isNotNull() & p.isNotNull() & (n > 0)
    return rows.where(ok).groupBy(*keys, F.bround(age, 1).alias("age")).agg(F.sum(p * n).alias("x"), F.sum(n).alias("n"))


def _positivity(a: Column) -> tuple[Column, Column, Column]:
    """Positivity at an age, and its derivatives by the two parameters ``p1`` and ``p2`` of the row's model."""
    l, m, c = F.col("p1"), F.col("p2"), F.col("change_point").cast("double")  # noqa: E741
    early, late = F.least(a, c), F.greatest(a - c, F.lit(0.0))
    s = l + m
    gone = F.exp(-s * a)
    model = F.col("model")
    steady = F.exp(-l * a)
    phased = F.exp(-(l * early + m * late))
    p = F.when(model == "constant", 1 - steady).when(model == "two_phase", 1 - phased).otherwise(l / s * (1 - gone))
    d1 = F.when(model == "constant", a * steady).when(model == "two_phase", early * phased).otherwise(m / (s * s) * (1 - gone) + l / s * a * gone)
    d2 = F.when(model == "reversion", l / s * a * gone - l / (s * s) * (1 - gone)).when(model == "two_phase", late * phased).otherwise(0.0)
    return p, d1, d2


def _sums(keys: list[str], points: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """Log likelihood, score and expected information of each row of parameters over its group's ages."""
    rows = params.join(points, keys)
    p, d1, d2 = _positivity(F.col("age"))
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = rows.withColumns({"p": p, "d1": d1, "d2": d2})
    n, y, p, d1, d2 = (F.col(c) for c in ("n", "y", "p", "d1", "d2"))
    w = n / (p * (1 - p))
    return rows.groupBy(*by).agg(
        F.sum(n * (y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("ll"),
        F.sum(w * (y - p) * d1).alias("s1"), F.sum(w * (y - p) * d2).alias("s2"),
        F.sum(w * d1 * d1).alias("i11"), F.sum(w * d1 * d2).alias("i12"), F.sum(w * d2 * d2).alias("i22"),
        F.max("age").alias("oldest"), F.count("*").alias("n_ages"),
    )


def _starts(groups: DataFrame, reversion: float | None) -> DataFrame:
    """The grid of first parameters of every group, one row each."""
    rate = [F.lit(r) for r in _START_RATES]

    def grid(model: str, first: list[Column], second: list[Column], change: tuple = (None,)) -> DataFrame:
        rows = groups.withColumns({"model": F.lit(model), "change_point": F.explode(F.array(*[F.lit(c).cast("int") for c in change]))})
        return rows.withColumn("p1", F.explode(F.array(*first))).withColumn("p2", F.explode(F.array(*second)))

    if reversion is not None:
        return grid("fixed_reversion", rate, [F.lit(float(reversion))])
    parts = [grid("constant", rate, [F.lit(0.0)]), grid("reversion", rate, [F.lit(m) for m in _START_REVERSIONS]), grid("two_phase", rate, rate, CHANGE_POINTS)]
    return reduce(DataFrame.unionByName, parts)


def fit_catalytic(points: DataFrame, keys: list[str], reversion: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The fitted models of each group of ``keys, age, x, n``: parameters with intervals, likelihood, criteria and weights.

    With ``reversion`` only the model of that given rate is fitted. Ages of zero or less and rows without people don't
    count; positivity is kept ``EDGE`` away from 0 and 1. A model whose information is singular has no intervals.
    """
    tables = Tables(points.sparkSession, "catalytic")
    y = F.least(F.greatest(F.col("x") / F.col("n"), F.lit(EDGE)), F.lit(1 - EDGE))
    points = tables.write(points.where((F.col("age") > 0) & (F.col("n") > 0)).select(*keys, "age", "n", y.alias("y")))
    by = [*keys, "model", "change_point"]
    start = _sums(keys, points, _starts(points.select(*keys).distinct(), reversion), [*by, "p1", "p2"])
    best = start.groupBy(*by).agg(F.max_by(F.struct("p1", "p2"), F.struct("ll", -F.col("p1"), -F.col("p2"))).alias("s"))
    state = best.select(*by, "s.p1", "s.p2", F.col("s.p1").alias("b1"), F.col("s.p2").alias("b2"), F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("t1"), F.lit(0.0).alias("t2"))
    keep = ["p1", "p2", "b1", "b2", "best", "t1", "t2"]
    for k in range(rounds):
        now = _sums(keys, points, state, [*by, *keep])
        # at a better point a new step begins there; at a worse one the last step is halved
        better = F.col("ll") >= F.col("best")
        free = F.col("model").isin("reversion", "two_phase")
        det = F.col("i11") * F.col("i22") - F.col("i12") * F.col("i12")
        sound = free & (det > 1e-12 * F.col("i11") * F.col("i22"))
        step1 = F.when(sound, (F.col("i22") * F.col("s1") - F.col("i12") * F.col("s2")) / det).otherwise(F.coalesce(F.try_divide("s1", "i11"), F.lit(0.0)))
        step2 = F.when(sound, (F.col("i11") * F.col("s2") - F.col("i12") * F.col("s1")) / det).otherwise(0.0)
        now = now.withColumns({
            "b1": F.when(better, F.col("p1")).otherwise(F.col("b1")), "b2": F.when(better, F.col("p2")).otherwise(F.col("b2")),
            "t1": F.when(better, step1).otherwise(F.col("t1") / 2), "t2": F.when(better, step2).otherwise(F.col("t2") / 2), "best": F.greatest("ll", "best"),
        })
        low = F.when(free, LEAST_RATE).otherwise(F.col("b2"))
        high = F.when(free, MOST_RATE).otherwise(F.col("b2"))
        moved = {"p1": F.least(F.greatest(F.col("b1") + F.col("t1"), F.lit(LEAST_RATE)), F.lit(MOST_RATE)), "p2": F.least(F.greatest(F.col("b2") + F.col("t2"), low), high)}
        state = now.select(*by, *[moved[c].alias(c) if c in moved else c for c in keep])
        if k % 4 == 3:
            state = tables.write(state)
    final = _sums(keys, points, state.select(*by, F.col("b1").alias("p1"), F.col("b2").alias("p2")), [*by, "p1", "p2"])
    return tables.write(_reported(final, keys))


def _reported(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Best change point of each model, standard errors, criteria, weights."""
    best = W.partitionBy(*keys, "model").orderBy(F.desc("ll"), "change_point")
    rows = fits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).drop("_n")
    two = F.col("model").isin("reversion", "two_phase")
    det = F.col("i11") * F.col("i22") - F.col("i12") * F.col("i12")
    sound = F.when(two, (det > 1e-12 * F.col("i11") * F.col("i22")) & (F.col("i11") > 0)).otherwise(F.col("i11") > 0)
    se1 = F.when(sound, F.sqrt(F.when(two, F.col("i22") / det).otherwise(1 / F.col("i11"))))
    se2 = F.when(sound & two, F.sqrt(F.col("i11") / det))
    k = F.when(F.col("model") == "two_phase", 3).when(F.col("model") == "reversion", 2).otherwise(1)  # the change point counts
    rows = rows.withColumns({"k": k, "se1": se1, "se2": se2})
    rows = rows.withColumns({"aic": F.round(2 * F.col("k") - 2 * F.col("ll"), 3), "bic": F.round(F.col("k") * F.ln(F.greatest(F.col("n_ages"), F.lit(2))) - 2 * F.col("ll"), 3)})
    group = W.partitionBy(*keys)
    rows = rows.withColumn("delta_aic", F.round(F.col("aic") - F.min("aic").over(group), 3))
    weight = F.exp(-F.col("delta_aic") / 2)
    rows = rows.withColumn("weight", F.round(weight / F.sum(weight).over(group), 6)).withColumn("rank", F.row_number().over(group.orderBy("aic", "k")))

    def bound(value: str, error: str, sign: int) -> Column:
        return F.when(F.col(error).isNotNull(), F.round(F.greatest(F.col(value) + sign * Z * F.col(error), F.lit(0.0)), 6))

    age = F.greatest("oldest", F.lit(1.0))
    phased = (F.col("p1") * F.least(age, F.col("change_point")) + F.col("p2") * F.greatest(age - F.col("change_point"), F.lit(0.0))) / age
    second = F.col("model") != "constant"
    return rows.select(
        *keys, "model", F.col("n_ages").cast("long").alias("n_ages"), F.round("p1", 6).alias("rate"), bound("p1", "se1", -1).alias("rate_lower"), bound("p1", "se1", 1).alias("rate_upper"),
        F.when(second, F.round("p2", 6)).alias("second"), bound("p2", "se2", -1).alias("second_lower"), bound("p2", "se2", 1).alias("second_upper"), "change_point",
        F.round("ll", 6).alias("loglik"), "aic", "bic", "delta_aic", "weight", (F.col("rank") == 1).alias("recommended"),
        F.round(F.when(F.col("model") == "two_phase", phased).otherwise(F.col("p1")), 6).alias("average_force"),
    )


def reversion_test(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Likelihood-ratio test of the reversion model against the constant one, one degree of freedom."""
    ll = {m: F.max(F.when(F.col("model") == m, F.col("loglik"))) for m in ("constant", "reversion")}
    chi = F.greatest(2 * (ll["reversion"] - ll["constant"]), F.lit(0.0))
    rows = fits.groupBy(*keys).agg(F.round(chi, 4).alias("chi_square"))
    return rows.withColumn("p_value", F.round(F.least(F.greatest(1 - erf(F.sqrt(F.col("chi_square") / 2)), F.lit(0.0)), F.lit(1.0)), 6))


def fitted_curve(fits: DataFrame, oldest: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, age, prevalence`` in percent of each group's recommended model, at every whole year up to its oldest age."""
    rows = fits.where("recommended").select(*keys, "model", F.col("rate").alias("p1"), F.coalesce("second", F.lit(0.0)).alias("p2"), "change_point").join(oldest, keys)
    ages = F.sequence(F.ceil(F.col("youngest")).cast("int"), F.greatest(F.floor("oldest").cast("int"), F.ceil(F.col("youngest")).cast("int")))
    rows = rows.withColumn("age", F.explode(ages)).withColumn("age", F.col("age").cast("double"))
    return rows.select(*keys, "model", "age", F.round(F.least(F.greatest(_positivity(F.col("age"))[0], F.lit(0.0)), F.lit(1.0)) * 100, 2).alias("prevalence"))
