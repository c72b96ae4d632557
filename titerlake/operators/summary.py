"""Grouped summaries: rates, concentrations, maps, gaps, equity, goals, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titerlake.functions import stats


def sero(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("data_type") == "seroprevalence").withColumn("p", stats.as_proportion(F.col("value"))).withColumn("n", F.col("sample_size").cast("double"))


def rate_by(obs: DataFrame, *keys: str | Column) -> DataFrame:
    parts = stats.weighted_rate(F.col("p"), F.col("n"))
    return sero(obs).groupBy(*keys).agg(*[c.alias(k) for k, c in parts.items()], F.count("*").alias("n_points"))


def gmc_by(obs: DataFrame, *keys: str | Column) -> DataFrame:
    parts = stats.gmc(F.col("value"), F.col("sample_size"))
    return obs.where(F.col("data_type") == "gmc").groupBy(*keys).agg(*[c.alias(k) for k, c in parts.items()])


def map_rate_by(obs: DataFrame, *keys: str | Column) -> DataFrame:
    """Counts, distinct sources, samples and the weighted percent of the map rules."""
    v, n = stats.map_percent(F.col("value")), F.when(F.col("sample_size") > 0, F.col("sample_size").cast("double"))
    mine = F.col("data_type") == "seroprevalence"
    return obs.groupBy(*keys).agg(
        F.count("*").alias("n_points"),
        F.countDistinct(F.coalesce(F.col("source_id").cast("string"), F.lit(""))).alias("n_sources"),
        F.sum("sample_size").cast("long").alias("samples"),
        F.round(F.try_divide(F.sum(F.when(mine, v * n)), F.sum(F.when(mine, n))), 2).alias("rate"),
    )


def ranked(frame: DataFrame, value: str, tie: str) -> DataFrame:
    """Position by value, largest first; null values get no rank."""
    order = W.orderBy(F.col(value).desc_nulls_last(), F.col(tie))
    return frame.withColumn("rank", F.when(F.col(value).isNotNull(), F.row_number().over(order)))


def gini(frame: DataFrame, value: str) -> DataFrame:
    """Gini coefficient, coefficient of variation and number of non-negative values, of an already small frame."""
    order = frame.where(F.col(value) >= 0).withColumn("i", F.row_number().over(W.orderBy(value)))
    n, total = F.count("*"), F.sum(value)
    raw = F.try_divide(2 * F.sum(F.col("i") * F.col(value)), n * total) - (n + 1) / n
    return order.agg(
        F.round(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)), 6).alias("gini"),
        F.round(F.coalesce(F.try_divide(F.stddev_samp(value), F.abs(F.avg(value))), F.lit(0.0)), 6).alias("cv"),
        n.alias("n_groups"),
    )


def goals(studies: DataFrame, target: float) -> DataFrame:
    """By disease and year: distance of the rate to the target, and the share of provinces that meet it."""
    per = studies.groupBy("disease", "collection_year", "province").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    met = (F.col("x") / F.col("n") * 100 >= target).cast("int")
    return per.groupBy("disease", "collection_year").agg(F.round(target - F.sum(F.col("x") * 100) / F.sum("n"), 2).alias("gap"), F.round(F.avg(met), 4).alias("ratio"))


def gap_counts(obs: DataFrame) -> DataFrame:
    """Approved points (grades A, B), pending points and years by disease and first province."""
    first = F.trim(F.element_at(F.split("province", ";"), 1))
    good = (F.col("review_status") == "approved") & F.col("quality_grade").isin("A", "B")
    return obs.groupBy("disease", first.alias("province")).agg(
        F.count_if(good).alias("approved_ab"), F.count_if(F.col("review_status") == "pending").alias("pending"), F.countDistinct("collection_year").alias("years")
    )


def review_times(obs: DataFrame) -> DataFrame:
    """Grouping sets by disease, by reviewer and in total, of reviewed rows."""
    done = obs.where(F.col("review_status") != "pending").withColumn("minutes", F.when(F.col("review_seconds") > 0, F.col("review_seconds") / 60.0))
    sets = done.groupingSets([[F.col("disease")], [F.col("reviewer_id")], []], F.col("disease"), F.col("reviewer_id"))
    return sets.agg(
        F.count("*").alias("reviewed"), F.round(F.avg((F.col("review_status") == "approved").cast("double")), 4).alias("pass_rate"), F.round(F.avg("minutes"), 2).alias("mean_minutes")
    )
