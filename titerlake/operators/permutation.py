"""Permutation tests of spatial statistics, the permutations held as rows.

The order of a permutation is that of the MD5 of seed, number and place, so any engine draws the same ones, however the
rows are dealt. Permutation 0 is the observed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statistics are compared after rounding, so that the order of a sum decides nothing.
_PLACES = 9


def _shuffle_key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col("permutation"), F.col("place")))


def permuted(values: DataFrame, keys: list[str], permutations: int, seed: int) -> DataFrame:
    """``keys, permutation, place, z``: the centred values of ``keys, place, x`` dealt anew to the places of their group."""
    group = W.partitionBy(*keys)
    rows = values.where(F.col("x").isNotNull()).select(*keys, "place", (F.col("x") - F.avg("x").over(group)).alias("z"), F.row_number().over(group.orderBy("place")).alias("slot"))
    drawn = rows.select(*keys, "place", "slot", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("permutation"))
    order = F.row_number().over(W.partitionBy(*keys, "permutation").orderBy(_shuffle_key(seed), "place"))
    drawn = drawn.select(*keys, "permutation", "place", F.when(F.col("permutation") == 0, F.col("slot")).otherwise(order).alias("slot"))
    return drawn.join(rows.select(*keys, "slot", "z"), [*keys, "slot"]).select(*keys, "permutation", "place", "z")


def _share(simulated: Column, observed: Column) -> Column:
    """Share of permutations as extreme as the observed one on its side, the observed one counted."""
    n = F.size(simulated)
    above = F.size(F.filter(simulated, lambda s: s >= observed))
    return (F.least(above, n - above) + 1) / (n + 1)


def moran_test(values: DataFrame, edges: DataFrame, keys: list[str], permutations: int = 999, seed: int = 7, least: int = 8) -> DataFrame:
    """Moran's I of each group with row-standardised weights of ``edges(src, dst)``, its permutation p and z, and the pattern they show.

    Neighbours without a value don't count. Groups of fewer than ``least`` places have none of it.
    """
    known = values.where(F.col("x").isNotNull()).select(*keys, "place")
    near = edges.select("src", "dst").distinct().join(known.withColumnRenamed("place", "src"), "src").join(known.withColumnRenamed("place", "dst"), [*keys, "dst"])
    weights = near.withColumn("w", 1 / F.count("*").over(W.partitionBy(*keys, "src")))
    z = permuted(values, keys, permutations, seed)
    a, b = (z.select(*keys, "permutation", F.col("place").alias(end), F.col("z").alias(f"z_{end}")) for end in ("src", "dst"))
    cross = weights.join(a, [*keys, "src"]).join(b, [*keys, "permutation", "dst"]).groupBy(*keys, "permutation").agg(F.sum(F.col("w") * F.col("z_src") * F.col("z_dst")).alias("cross"), F.sum("w").alias("s0"))
    spread = z.where(F.col("permutation") == 0).groupBy(*keys).agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.count("*").alias("n"))
    each = cross.join(spread, keys).select(*keys, "n", "permutation", F.round(F.try_divide(F.col("n") * F.col("cross"), F.col("s0") * F.col("zz")), _PLACES).alias("i"))
    by_group = each.groupBy(*keys).agg(
        F.first("n").alias("n"), F.max(F.when(F.col("permutation") == 0, F.col("i"))).alias("i"),
        F.collect_list(F.when(F.col("permutation") > 0, F.col("i"))).alias("simulated"),  # as many as permutations
        F.avg(F.when(F.col("permutation") > 0, F.col("i"))).alias("mean"), F.stddev_pop(F.when(F.col("permutation") > 0, F.col("i"))).alias("sd"),
    )
    p = _share(F.col("simulated"), F.col("i"))
    pattern = F.when(p >= 0.05, "random").when(F.col("i") > 0, "clustered").otherwise("dispersed")
    tested = (F.col("n") >= least) & F.col("i").isNotNull()
    out = {"morans_i": F.round("i", 6), "p_sim": F.round(p, 6), "z_sim": F.round(F.try_divide(F.col("i") - F.col("mean"), F.col("sd")), 4), "pattern": pattern}
    return by_group.select(*keys, "n", *[F.when(tested, c).alias(name) for name, c in out.items()])


def gi_star_test(values: DataFrame, edges: DataFrame, keys: list[str], permutations: int = 999, seed: int = 7, least: int = 8) -> DataFrame:
    """Conditional permutation p of each place's Gi*: its own value stays, its neighbours' are drawn from the other places.

    A permutation is one order of a group's places; a place takes the first ones of it but itself. The running sums of the
    order give that without a row for each neighbour. Groups of fewer than ``least`` places have no p.
    """
    known = values.where(F.col("x").isNotNull()).select(*keys, "place", "x")
    other = known.select(*keys, F.col("place").alias("dst"), F.col("x").alias("x_dst"))
    near = edges.select(F.col("src").alias("place"), "dst").where(F.col("place") != F.col("dst")).distinct().join(known, "place").join(other, [*keys, "dst"])
    seen = near.groupBy(*keys, "place").agg(F.count("*").alias("degree"), F.sum("x_dst").alias("near"))
    group = W.partitionBy(*keys)
    places = known.join(seen, [*keys, "place"], "left").select(
        *keys, "place", "x", F.coalesce("degree", F.lit(0)).alias("degree"), (F.col("x") + F.coalesce("near", F.lit(0.0))).alias("observed"), F.count("*").over(group).alias("n")
    )
    drawn = places.select("*", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("permutation"))
    order = W.partitionBy(*keys, "permutation").orderBy(_shuffle_key(seed), "place")
    drawn = drawn.withColumns({"rank": F.row_number().over(order), "running": F.sum("x").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))})
    inside = F.col("rank") <= F.col("degree")
    ends = drawn.select(*keys, "permutation", F.col("rank").alias("last"), F.col("running").alias("total"))
    taken = drawn.withColumn("last", F.col("degree") + inside.cast("int")).join(ends, [*keys, "permutation", "last"], "left")
    simulated = F.col("x") + F.coalesce("total", F.lit(0.0)) - F.when(inside, F.col("x")).otherwise(0.0)
    above = F.count_if(F.round(simulated, _PLACES) >= F.round("observed", _PLACES))
    counts = taken.groupBy(*keys, "place").agg(F.first("n").alias("n"), F.first("degree").alias("degree"), above.alias("above"), F.count("*").alias("k"))
    p = (F.least("above", F.col("k") - F.col("above")) + 1) / (F.col("k") + 1)
    return counts.select(*keys, "place", "degree", F.when(F.col("n") >= least, F.round(p, 6)).alias("p_sim"))
