"""Groups of sources that are copies of each other, by any chain of reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerlake.functions.wording import normal_title
from titerlake.operators.linkage import title_pairs, title_tokens
from titerlake.sources.shared import Tables


def links(sources: DataFrame, least: float = 0.7) -> DataFrame:
    """``a, b, reason``: every source with the first one of equal DOI (in any case), file hash, or normal title; and of similar titles.

    A group of equal sources is a star, so its links are as many as its rows. Blank DOIs, hashes and titles link nothing.
    """
    keys = {"doi": F.lower("doi"), "file_hash": F.col("file_hash"), "title": normal_title(F.col("title"))}
    stars = []
    for reason, key in keys.items():
        rows = sources.select("source_id", key.alias("k")).where(F.length("k") > 0)
        hubs = rows.groupBy("k").agg(F.min("source_id").alias("a")).join(rows, "k")
        stars.append(hubs.select("a", F.col("source_id").alias("b"), F.lit(reason).alias("reason")))
    tokens = title_tokens(sources)
    hubs = tokens.groupBy("who", "tokens").agg(F.min(F.struct("source_id", "title")).alias("hub")).join(tokens, ["who", "tokens"])
    stars.append(hubs.where(F.col("hub.title") != F.col("title")).select(F.col("hub.source_id").alias("a"), F.col("source_id").alias("b"), F.lit("title+authors").alias("reason")))
    stars.append(title_pairs(sources, least).select("a", "b", F.lit("title+authors").alias("reason")))
    return reduce(DataFrame.unionByName, stars).where(F.col("a") != F.col("b"))


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """``node, root``: the least node reachable from each node of ``edges(a, b)``.

    Each round takes the least root among a node's neighbours, then the root of that root, so long chains take few
    rounds. Rounds are written tables, of which the last two stay; only the number of changes comes to the driver.
    """
    both = tables.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = tables.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        seen = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(seen, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        jump = roots.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        after = tables.write(lower.join(jump, "mid", "left").select("node", "was", F.least("mid", "far").alias("root")))
        tables.drop(roots)
        roots = after
        if not after.where(F.col("was") != F.col("root")).count():
            tables.drop(both)
            return after.select("node", "root")


def duplicate_components(sources: DataFrame, least: float = 0.7) -> DataFrame:
    """``group_id`` (least id), its number of sources, all reasons, and the source created first, of each group of two or more."""
    tables = Tables(sources.sparkSession, "duplicates")
    sources = tables.write(sources.select("source_id", "title", "authors", "created_at", "file_hash", "doi"))  # texts are read once
    edges = tables.write(links(sources, least))
    roots = components(edges, tables)
    reasons = edges.join(roots, F.col("a") == F.col("node")).groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    members = roots.join(sources.select("source_id", "created_at"), F.col("node") == F.col("source_id"))
    groups = members.groupBy("root").agg(F.count("*").alias("n_sources"), F.min(F.struct("created_at", "source_id"))["source_id"].alias("representative_id"))
    return groups.join(reasons, "root").withColumnRenamed("root", "group_id")
