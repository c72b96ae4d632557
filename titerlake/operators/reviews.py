"""Review actions and maintenance, as new tables: verdicts, restores, renames, tags, title repair, and who reviewed what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.functions.titles import repaired
from titerlake.sources.adapters import dealt


def reviewed(facts: DataFrame, verdicts: DataFrame, tasks: int = 0) -> DataFrame:
    """Facts with the verdicts in: ``fact_id, source_id, status, comment, reviewer_id, reviewed_at``; one of a source that the fact isn't from
    changes nothing, of several for a fact the last one counts. Facts and verdicts meet in ``tasks`` tasks, if these are
    more than the session's.
    """
    last = dealt(verdicts, tasks, "fact_id", "source_id").groupBy("fact_id", "source_id").agg(F.max_by(F.struct("status", "comment", "reviewer_id", "reviewed_at"), "reviewed_at").alias("_v"))
    joined = facts.join(last, ["fact_id", "source_id"], "left")
    taken = {"review_status": "status", "review_comment": "comment", "reviewer_id": "reviewer_id", "reviewed_at": "reviewed_at"}
    return joined.select(*[F.when(F.col("_v").isNotNull(), F.col("_v")[taken[c]]).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in facts.columns])


def restored(sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Sources with the deleted ones of ``ids(source_id)`` taken back."""
    back = ids.select("source_id").distinct().withColumn("_back", F.lit(True))
    rows = sources.join(back, "source_id", "left")
    return rows.select(*[F.when(F.col("_back").isNull(), F.col(c)).alias(c) if c in ("deleted_at", "deleted_by") else F.col(c) for c in sources.columns])


def renamed(facts: DataFrame, column: str, new: Column) -> tuple[DataFrame, DataFrame]:
    """Facts with ``column`` renamed, and how many rows each changed pair of names has; null stays."""
    rows = facts.withColumn("_new", F.when(F.col(column).isNotNull(), new))
    changed = rows.where(~F.col(column).eqNullSafe(F.col("_new"))).groupBy(F.col(column).alias("old"), F.col("_new").alias("new")).agg(F.count("*").alias("n"))
    return rows.withColumn(column, F.col("_new")).drop("_new"), changed


def retagged(bridge: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bridge ``source_id, tag`` with the tags of the sources in ``wanted(source_id, tags)`` replaced; an empty list takes all off."""
    rest = bridge.join(wanted.select("source_id").distinct(), "source_id", "left_anti")
    return rest.select("source_id", "tag").unionByName(wanted.select("source_id", F.explode(F.array_distinct("tags")).alias("tag")).distinct())


def title_changes(sources: DataFrame) -> DataFrame:
    """``source_id, old_title, new_title`` where the repair of a title changes it: the dry run of ``repaired``."""
    return sources.select("source_id", F.col("title").alias("old_title"), repaired(F.col("title")).alias("new_title")).where(F.col("old_title") != F.col("new_title"))


def named_reviewers(stats: DataFrame, users: DataFrame) -> DataFrame:
    """Review statistics with the reviewer's display name, else the user's name, else the id; a null id keeps a null name."""
    people = users.select("reviewer_id", F.coalesce(F.nullif("display_name", F.lit("")), F.nullif("username", F.lit(""))).alias("_name"))
    rows = stats.join(people, "reviewer_id", "left")
    return rows.select(*stats.columns, F.coalesce("_name", F.col("reviewer_id").cast("string")).alias("reviewer"))


def unapproved(facts: DataFrame, approved: DataFrame, key: str = "fact_id") -> DataFrame:
    """All facts but the approved ones, by id."""
    return facts.join(approved.select(key).distinct(), key, "left_anti")


def recent_rejected(facts: DataFrame, issues: Column, most: int = 20) -> DataFrame:
    """The facts rejected last, at most ``most``, with what is wrong with each as one text."""
    rows = facts.where(F.col("review_status") == "rejected").orderBy(F.col("reviewed_at").desc_nulls_last(), "fact_id").limit(most)
    return rows.withColumn("issues", F.array_join(issues, "; "))
