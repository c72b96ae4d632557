"""Scores that follow reviews: a stream that scores each version of a fact once, and forgets facts that nothing happens to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "fact_id long, version long, score int, action string"


def rescored(events: DataFrame, keep: str = "30 days", late: str = "1 hour") -> DataFrame:
    """``fact_id, version, score, action`` of a stream of ``fact_id, version, review_status, score, updated_at``.

    A fact's newest version is emitted as ``score`` if it is approved, and as ``withdraw`` if it was scored and no longer is. A
    version seen before, or an older one, changes nothing, so replayed input changes nothing. A fact without
    an event for ``keep`` (of event time) is forgotten, with a row ``expire``.
    """
    days, unit = keep.split()
    kept_ms = int(days) * {"days": 86_400_000, "hours": 3_600_000, "minutes": 60_000}[unit if unit.endswith("s") else unit + "s"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            version, score, _ = state.get
            state.remove()
            yield pd.DataFrame({"fact_id": [key[0]], "version": [version], "score": [score], "action": ["expire"]})
            return
        version, score, scored = state.get if state.exists else (-1, 0, False)
        rows = pd.concat(list(batches))
        newest = rows.sort_values("version").iloc[-1]
        seen = int(pd.to_datetime(rows["updated_at"]).max().timestamp() * 1000)
        out = []
        if newest["version"] > version:
            version, approved = int(newest["version"]), newest["review_status"] == "approved"
            if approved:
                score = int(newest["score"])
                out.append((key[0], version, score, "score"))
            elif scored:
                out.append((key[0], version, score, "withdraw"))
            scored = bool(approved)
        state.update((version, score, scored))
        state.setTimeoutTimestamp(max(seen + kept_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["fact_id", "version", "score", "action"]).astype({"fact_id": "int64", "version": "int64", "score": "int32", "action": "object"})

    rows = events.where(F.col("fact_id").isNotNull() & F.col("version").isNotNull() & F.col("updated_at").isNotNull()).withWatermark("updated_at", late)
    rows = rows.select(F.col("fact_id").cast("long"), F.col("version").cast("long"), F.coalesce("review_status", F.lit("pending")).alias("review_status"), F.coalesce("score", F.lit(0)).cast("int").alias("score"), "updated_at")
    return rows.groupBy("fact_id").applyInPandasWithState(step, _OUT, "version long, score int, scored boolean", "update", GroupStateTimeout.EventTimeTimeout)


def waiting_for_score(facts: DataFrame, most: int = 500) -> DataFrame:
    """Approved facts without a score, those changed longest ago first; at most 500."""
    rows = facts.where((F.col("review_status") == "approved") & F.col("quality_score").isNull())
    return rows.orderBy(F.col("updated_at").asc_nulls_first(), "fact_id").limit(max(1, min(most, 500)))


def upsert_scores(scores: DataFrame, changes: DataFrame) -> DataFrame:
    """A table of ``fact_id, version, score`` once the rows of ``rescored`` are in; rows of older versions change nothing."""
    newest = changes.groupBy("fact_id").agg(F.max_by(F.struct("version", "score", "action"), "version").alias("c")).select("fact_id", "c.*")
    both = scores.select("fact_id", F.struct("version", "score").alias("old")).join(newest.select("fact_id", F.struct("version", "score", "action").alias("new")), "fact_id", "full")
    wins = F.col("old").isNull() | (F.col("new.version") > F.col("old.version"))
    state = F.when(F.col("new").isNotNull() & wins, F.struct(F.col("new.version").alias("version"), F.col("new.score").alias("score"), (F.col("new.action") == "withdraw").alias("gone")))
    state = F.coalesce(state, F.struct(F.col("old.version").alias("version"), F.col("old.score").alias("score"), F.lit(False).alias("gone")))
    return both.select("fact_id", state.alias("s")).where(~F.col("s.gone")).select("fact_id", "s.version", "s.score")
