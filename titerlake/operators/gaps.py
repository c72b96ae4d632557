"""What the evidence lacks: one count of all facts by six keys, and the lists made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.functions import stats
from titerlake.sources.shared import Tables


def base_counts(facts: DataFrame) -> DataFrame:
    """Facts by province, city, year, disease, state and grade, written once; all lists read it, and it is as small as its keys."""
    counts = facts.groupBy("province", "city", "collection_year", "disease", "review_status", "quality_grade").agg(F.count("*").alias("n"))
    return Tables(facts.sparkSession, "gaps").write(counts)


def _names(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[;；]"), lambda x: F.trim(x)), lambda x: x != "")


def _counted(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by state of the first province, with score and status."""
    state, n = F.col("review_status"), F.col("n")
    rows = counts.withColumn("province", F.get(_names(F.col("province")), 0)).where(F.col("province").isNotNull())

    def of(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    good = (state == "approved") & F.col("quality_grade").isin("A", "B")
    sums = rows.groupBy(*keys).agg(of(state == "pending").alias("pending"), of(state == "approved").alias("approved"), of(good).alias("approved_ab"), of(state == "rejected").alias("rejected"), F.sum("n").alias("total"))
    return sums.withColumns({"completeness": stats.completeness(F.col("approved_ab"), F.col("pending")), "status": stats.status_label(F.col("approved_ab"), F.col("pending"))})


def overview(counts: DataFrame) -> DataFrame:
    """One row: facts by state, and how many provinces, cities, diseases and years they name."""
    state, n = F.col("review_status"), F.col("n")
    sums = counts.agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(state == s, n)), F.lit(0)).alias(s) for s in ("pending", "approved", "rejected")], F.countDistinct("disease").alias("diseases"), F.countDistinct(F.nullif(F.col("collection_year"), F.lit(0))).alias("years"))
    provinces = counts.select(F.explode(_names(F.col("province"))).alias("p")).agg(F.countDistinct("p").alias("provinces"))
    cities = counts.select(F.explode(_names(F.col("city"))).alias("c")).agg(F.countDistinct("c").alias("cities"))
    return sums.join(provinces).join(cities)  # one row each


def review_needed(counts: DataFrame) -> DataFrame:
    """Province, year and disease that wait for review, most pending first."""
    rows = _counted(counts, ["province", "collection_year", "disease"]).where(F.col("status").isin("need_review", "need_both"))
    return rows.orderBy(F.desc("pending"), F.desc("completeness"), "province", "collection_year", "disease")


def supplement_needed(counts: DataFrame) -> DataFrame:
    """Province, year and disease that lack facts, those without any first."""
    rows = _counted(counts, ["province", "collection_year", "disease"]).where(F.col("status").isin("need_supplement", "need_both"))
    return rows.orderBy("approved", "pending", F.desc("total"), "province", "collection_year", "disease")


def coverage(counts: DataFrame, provinces: list[str]) -> DataFrame:
    """By disease: the provinces it has facts of and those of the fixed list that it lacks; the most complete first."""
    found = counts.where(F.col("disease").isNotNull()).select("disease", F.explode_outer(_names(F.col("province"))).alias("p"))
    rows = found.groupBy("disease").agg(F.array_sort(F.collect_set("p")).alias("covered"))
    wanted = F.array(*[F.lit(p) for p in provinces]).cast("array<string>")
    rows = rows.withColumn("missing", F.array_except(wanted, "covered"))
    share = F.when(F.size("missing") == 0, 100.0).otherwise(F.round(F.size("covered") / max(len(provinces), 1) * 100, 2))
    rows = rows.select("disease", "covered", "missing", F.size("covered").alias("n_covered"), F.size("missing").alias("n_missing"), F.least(share, F.lit(100.0)).alias("percent"))
    return rows.orderBy("n_missing", F.desc("n_covered"), "disease")


def year_matrix(counts: DataFrame) -> DataFrame:
    """By province and year, and by province alone (a null year with ``whole``): counts, score and status."""
    cells = _counted(counts, ["province", "collection_year"]).withColumn("whole", F.lit(False))
    rows = _counted(counts, ["province"]).withColumns({"collection_year": F.lit(None).cast("int"), "whole": F.lit(True)})
    return cells.unionByName(rows)
