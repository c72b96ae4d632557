"""Connected components of an edge table by alternating large-star and small-star steps.

Only minima per vertex are aggregated, never lists of neighbours, so a vertex with very many edges is no problem:
partial aggregation shrinks it and the join back can be split. Each step is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerlake.llm.scratch import Scratch

MOST_ROUNDS = 60
#: Edges of a file of a step, and files of a step at least: small graphs aren't written as very many tiny files.
FILE_EDGES, LEAST_FILES = 200_000, 12


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` holds (u, v) with u > v. Large star hangs u's larger neighbours on the least one; small star the smaller."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every vertex of ``edges(a, b)`` that isn't the least of its component; ``root`` is the least."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") > F.col("v")).distinct(), "edges")

    def state(frame: DataFrame) -> tuple:
        row = frame.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    before = state(now)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        files = max(LEAST_FILES, -(-before[0] // FILE_EDGES))  # coalesce never makes more than there are
        middle = scratch.save(_star(now, large=True).coalesce(files), "large")
        after = scratch.save(_star(middle, large=False).coalesce(files), "small")
        for frame in (now, middle):
            scratch.drop(frame)
        now, last = after, before
        before = state(now)
        if before == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
