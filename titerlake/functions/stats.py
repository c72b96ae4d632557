"""Statistical Column functions; all stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from titerlake.functions.distributions import T_CRITICAL

Z = 1.96


def as_proportion(value: Column) -> Column:
    """Percent or fraction to a proportion; null outside 0..1 (exactly 1 is 100 percent)."""
    p = F.when(value > 1, value / 100).otherwise(value)
    return F.when((p >= 0) & (p <= 1), p)


def map_percent(value: Column) -> Column:
    """Fraction or percent to a percent in 0..100; negative is 0."""
    return F.round(F.least(F.greatest(F.when((value > 0) & (value <= 1), value * 100).otherwise(value), F.lit(0.0)), F.lit(100.0)), 4)


def age_midpoint(low: Column, high: Column) -> Column:
    both = F.when(high >= low, (low + high) / 2)
    return F.when(low.isNotNull() & high.isNotNull(), both).when(low.isNotNull(), low + 2.5).when(high.isNotNull(), high / 2)


def age_band(mid: Column) -> Column:
    """Band by midpoint."""
    return F.when(mid < 1, "<1").when(mid < 5, "1-4").when(mid < 15, "5-14").when(mid < 60, "15-59").otherwise("60+")


def weighted_rate(p: Column, n: Column) -> dict[str, Column]:
    """Sample-size weighted rate with normal interval, in percent."""
    total = F.sum(F.when(p.isNotNull(), n))
    rate = F.try_divide(F.sum(p * n), total)
    error = F.try_divide(F.sqrt(F.sum(n * p * (1 - p))), total)
    return {
        "rate": F.round(rate * 100, 2),
        "ci_lower": F.round(F.greatest(rate - Z * error, F.lit(0.0)) * 100, 2),
        "ci_upper": F.round(F.least(rate + Z * error, F.lit(1.0)) * 100, 2),
        "total_sample": total.cast("long"),
    }


def gmc(value: Column, n: Column) -> dict[str, Column]:
    """Weighted geometric mean and log-domain interval from one pass of moments."""
    ok = (value > 0) & (n > 0)
    x, w = F.when(ok, F.ln(value)), F.when(ok, n.cast("double"))
    k, sw, sx, sxx = F.count(x), F.sum(w), F.sum(w * x), F.sum(w * x * x)
    mean = F.try_divide(sx, sw)
    var = F.when(k > 1, F.greatest(F.try_divide(k * (sxx - sx * mean), sw * (k - 1)), F.lit(0.0)))
    error = F.sqrt(F.try_divide(var, k))
    return {"gmc": F.round(F.exp(mean), 4), "ci_lower": F.round(F.exp(mean - Z * error), 4), "ci_upper": F.round(F.exp(mean + Z * error), 4), "n_values": k}


def gmc_t(value: Column) -> dict[str, Column]:
    """Geometric mean with the t interval of the logs; the normal one from 31 degrees of freedom on."""
    x = F.when(value > 0, F.ln(value))
    n, mean, error = F.count(x), F.avg(x), F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(x))
    t = F.coalesce(F.try_element_at(F.array(*map(F.lit, T_CRITICAL.values())), F.when(n > 1, (n - 1).cast("int")).otherwise(1)), F.lit(Z))
    return {"gmc": F.round(F.exp(mean), 4), "ci_lower": F.round(F.exp(mean - t * error), 4), "ci_upper": F.round(F.exp(mean + t * error), 4), "n": n}


def status_label(approved: Column, pending: Column, enough: int = 5) -> Column:
    """What a group of facts lacks: more of them, reviews, both, or nothing."""
    few = F.when(approved < enough, F.when((approved > 0) & (pending > 0), "need_both").when(pending > 0, "need_review").otherwise("need_supplement"))
    return F.coalesce(few, F.when(pending > 0, "need_review").otherwise("well_covered"))


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def wilson(p: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def erf(x: Column) -> Column:
    """Polynomial approximation 7.1.26 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return (1 + erf(z / math.sqrt(2))) / 2


def ft_transform(x: Column, n: Column) -> Column:
    return F.asin(F.sqrt(x / (n + 1))) + F.asin(F.sqrt((x + 1) / (n + 1)))


def ft_inverse(t: Column, n: Column) -> Column:
    """Closed form of the double arcsine's inverse, clamped at its ends."""
    low = F.asin(F.sqrt(1 / (n + 1)))
    high = F.asin(F.sqrt(n / (n + 1))) + math.pi / 2
    s = F.sin(t)
    root = F.sqrt(F.greatest(1 - F.pow(s + (s - 1 / s) / n, 2), F.lit(0.0)))
    return F.when(t <= low, 0.0).when(t >= high, 1.0).otherwise(0.5 * (1 - F.signum(F.cos(t)) * root))


def chi2_90(df: Column) -> Column:
    """The 90 percent point of chi-square by the Wilson-Hilferty cube."""
    a = 2 / (9 * df)
    return df * F.pow(1 - a + 1.2815515655446004 * F.sqrt(a), 3)


def naive_foi(percent: Column, age: Column) -> Column:
    """Force of infection from positivity at an age; capped at 99.99 percent."""
    return F.when(age <= 0, None).when(percent <= 0, 0.0).otherwise(-F.ln(1 - F.least(percent, F.lit(99.99)) / 100) / age)


def herd_threshold(r0: Column) -> Column:
    return F.when(r0 > 1, F.round((1 - 1 / r0) * 100, 2)).otherwise(0.0)


def barrier_status(rate: Column, target: Column) -> Column:
    known = F.when(rate >= target, "reached").when(rate >= target - 10, "near").otherwise("not_reached")
    return F.when(rate.isNull() | target.isNull(), "undetermined").otherwise(known)


def completeness(approved: Column, pending: Column) -> Column:
    return F.when(approved + pending > 0, F.greatest(F.round(F.least(approved / 5, F.lit(1.0)) * 70 - F.least(2.0 * pending, F.lit(30.0)), 2), F.lit(0.0))).otherwise(0.0)


def in_range(value: Column, data_type: Column) -> Column:
    """Whether a value can be of its type: a rate in 0..100, a concentration of 0 or more; null and other types can."""
    return F.coalesce(F.when(data_type == "seroprevalence", value.between(0, 100)).when(data_type == "gmc", value >= 0), F.lit(True))


def extraction_issues(value: Column, data_type: Column, known_place: Column, grounded: Column) -> Column:
    """What is wrong with an extracted fact, as a list of names."""
    checks = {"province_not_in_enum": ~known_place, "value_out_of_range": ~in_range(value, data_type), "not_grounded": ~grounded}
    return F.filter(F.array(*[F.when(bad, name) for name, bad in checks.items()]), lambda x: x.isNotNull())


def extraction_confidence(issues: Column) -> Column:
    """low for a wrong place, a wrong range, or two issues; else medium."""
    wrong = F.array_contains(issues, "province_not_in_enum") | F.array_contains(issues, "value_out_of_range")
    return F.when(wrong | (F.size(issues) >= 2), "low").otherwise("medium")
