"""Force of infection, herd-immunity barrier, vaccine effect, booster scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.functions import stats

LIFE_EXPECTANCY = 75.0


def foi_matrix(rows: DataFrame) -> DataFrame:
    """By disease, age band and province: weighted positivity and force of infection."""
    mid = stats.age_midpoint(F.col("age_min"), F.col("age_max"))
    rows = rows.where(F.col("data_type") == "seroprevalence").withColumns({"mid": mid, "foi": stats.naive_foi(F.col("value"), mid), "w": F.col("sample_size").cast("double")})
    return rows.groupBy("disease", stats.age_band(F.col("mid")).alias("age_band"), "province").agg(
        F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 2).alias("rate"),
        F.round(F.try_divide(F.sum(F.col("foi") * F.col("w")), F.sum(F.when(F.col("foi").isNotNull(), F.col("w")))), 6).alias("foi"),
        F.sum("w").cast("long").alias("samples"),
    )


def barrier(matrix: DataFrame) -> DataFrame:
    """By disease: reproduction number from the mean force of infection, threshold, and whether it is met."""
    per = matrix.groupBy("disease").agg(F.round(F.sum(F.col("foi") * F.col("samples")) / F.sum("samples"), 6).alias("foi"), F.round(F.sum(F.col("rate") * F.col("samples")) / F.sum("samples"), 2).alias("rate"))
    r0 = F.when(F.col("foi") > 0, F.round(F.col("foi") * LIFE_EXPECTANCY, 2))
    per = per.withColumn("r0", r0).withColumn("hit", stats.herd_threshold(F.col("r0")))
    return per.withColumn("status", stats.barrier_status(F.col("rate"), F.col("hit")))


def vaccine_effect(rows: DataFrame) -> DataFrame:
    """By disease: means of vaccinated and unvaccinated rows and the effect ``(1 - v/u) * 100``."""
    w = F.col("sample_size").cast("double")

    def mean(group: str) -> Column:
        mine = F.col("population") == group
        return F.round(F.try_divide(F.sum(F.when(mine, F.col("value") * w)), F.sum(F.when(mine, w))), 2)

    per = rows.where(F.col("data_type") == "seroprevalence").groupBy("disease").agg(mean("vaccinated").alias("vaccinated"), mean("unvaccinated").alias("unvaccinated"))
    v, u = F.col("vaccinated"), F.col("unvaccinated")
    return per.withColumn("effect", F.when((u > 0) & (v / u < 1), F.round((1 - v / u) * 100, 2)))


def booster(rates: DataFrame, boost: float, target: float) -> DataFrame:
    """Coverage after a booster for the susceptible, and the booster rate that reaches the target."""
    c, t = F.col("rate") / 100, target / 100
    need = F.when(c >= t, 0.0).otherwise((t - c) / (1 - c) * 100)
    return rates.withColumns({"effective": F.round(F.col("rate") + (1 - c) * boost, 4), "required": F.when(need <= 100, F.round(need, 2))})


def barrier_levels(rows: DataFrame) -> DataFrame:
    """The barrier of each disease over all its rows, by year and by province, from one pass over grouping sets.

    ``level`` says which; force and rate are means weighted by sample size over the rows themselves.
    """
    mid = stats.age_midpoint(F.col("age_min"), F.col("age_max"))
    w = F.col("sample_size").cast("double")
    each = rows.where((F.col("data_type") == "seroprevalence") & (w > 0)).select("disease", "collection_year", "province", "value", w.alias("w"), stats.naive_foi(F.col("value"), mid).alias("f"))
    d, year, place = F.col("disease"), F.col("collection_year"), F.col("province")
    level = F.when(F.grouping("collection_year") == 0, "year").when(F.grouping("province") == 0, "province").otherwise("overall")
    sets = each.groupingSets([[d], [d, year], [d, place]], d, year, place).agg(
        level.alias("level"),
        F.round(F.sum(F.col("f") * F.col("w")) / F.sum(F.when(F.col("f").isNotNull(), F.col("w"))), 6).alias("foi"),
        F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 2).alias("rate"),
    )
    r0 = F.when(F.col("foi") > 0, F.round(F.col("foi") * LIFE_EXPECTANCY, 2))
    sets = sets.withColumn("r0", r0).withColumn("hit", stats.herd_threshold(F.col("r0")))
    return sets.withColumn("status", stats.barrier_status(F.col("rate"), F.col("hit")))
