"""Spatial statistics over an edge list, and titer geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def morans_i(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Global Moran's I of ``place, x`` with row-standardised weights of ``edges(src, dst)``; null under 8 places."""
    mean = values.agg(F.avg("x").alias("m"), F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    v = values.select("place", "x")
    pairs = edges.join(v.withColumnRenamed("place", "src").withColumnRenamed("x", "xs"), "src").join(v.withColumnRenamed("place", "dst").withColumnRenamed("x", "xd"), "dst")
    lag = pairs.groupBy("src", "xs").agg(F.avg("xd").alias("lag"))
    sums = lag.agg(F.sum(F.col("xs") * F.col("lag")).alias("a"), F.sum("xs").alias("b"), F.sum("lag").alias("c"), F.count("*").alias("k"))
    both = sums.crossJoin(mean)  # one row each
    top = F.col("a") - F.col("m") * (F.col("b") + F.col("c")) + F.col("k") * F.col("m") * F.col("m")
    low = F.col("xx") - F.col("n") * F.col("m") * F.col("m")
    return both.select(F.col("n"), F.when(F.col("n") >= 8, F.round(F.try_divide(F.col("n") * top, F.col("k") * low), 6)).alias("morans_i"))


def gi_star(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Getis-Ord Gi* z with binary weights, each place its own neighbour too, and its hotspot class."""
    stat = values.agg(F.avg("x").alias("m"), F.count("*").alias("n"), F.stddev_pop("x").alias("s"))
    own = values.select(F.col("place").alias("src"), F.col("place").alias("dst"))
    near = edges.select("src", "dst").unionByName(own).distinct().join(values.select(F.col("place").alias("dst"), "x"), "dst")
    sums = near.groupBy("src").agg(F.sum("x").alias("sx"), F.count("*").alias("w")).crossJoin(F.broadcast(stat))  # stat is one row
    z = F.try_divide(F.col("sx") - F.col("m") * F.col("w"), F.col("s") * F.sqrt((F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1)))
    out = sums.select(F.col("src").alias("place"), F.round(z, 4).alias("z"))
    a = F.abs("z")
    side = F.when(F.col("z") > 0, "hot").otherwise("cold")
    return out.withColumn("cluster", F.when(a >= 2.576, F.concat(side, F.lit("_99"))).when(a >= 1.96, F.concat(side, F.lit("_95"))).when(a >= 1.645, F.concat(side, F.lit("_90"))).otherwise("none"))


def titer_distances(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Table distance of ``keys, antigen, serum, titer``: the serum's largest log2(titer / 10) less the cell's.

    Antigens with a titer that is missing or at the limit of detection are left out.
    """
    keys = keys or []
    bad = cells.where(F.col("titer").isNull() | (F.col("titer") <= 0)).select(*keys, "antigen").distinct()
    logs = cells.join(bad, [*keys, "antigen"], "left_anti").withColumn("lt", F.log2(F.col("titer") / 10))
    top = logs.groupBy(*keys, "serum").agg(F.max("lt").alias("top"))
    return logs.join(top, [*keys, "serum"]).select(*keys, "antigen", "serum", F.round(F.col("top") - F.col("lt"), 6).alias("distance"))


def antigen_distances(distances: DataFrame) -> DataFrame:
    """Euclidean distance of antigens over the sera both have."""
    a, b = (distances.select(F.col("antigen").alias(x), "serum", F.col("distance").alias(f"d{x}")) for x in "ab")
    return a.join(b, "serum").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.round(F.sqrt(F.sum(F.pow(F.col("da") - F.col("db"), 2))), 4).alias("distance"))
