"""Overlapping intervals: merged into longer ones, or cut so that each point is shown once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _behind(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct spans with ``reach``, the farthest end before them. Copies go before the window sorts."""
    before = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    return spans.select(*keys, "start", "end").distinct().withColumn("reach", F.max("end").over(before))


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that overlap or touch as one: ``start, end, n_spans`` (different ones)."""
    opens = (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")
    numbered = _behind(spans, keys).withColumn("group", F.sum(opens).over(W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_spans")).drop("group")


def visible(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each span from where the spans before it end; those that end earlier go."""
    start = F.greatest("start", F.coalesce("reach", "start"))
    return _behind(spans, keys).select(*keys, start.alias("start"), "end").where(F.col("start") < F.col("end"))
