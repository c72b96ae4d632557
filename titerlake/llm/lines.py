"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. Batches of documents arrive one
after another. Each batch anti-joins the runs of the earlier ones: a key found there drops all its lines in the
batch, a key new to the store stays in the batch's smallest doc_id only. Its new keys become a sorted run of level
0; ``fanout`` runs of one level are merged to one run of the next.

Defined cases: null and empty text are one empty line; a key under ``min_chars`` code points is never dropped;
repeated rows (same doc_id and text) count as one document and keep or lose the same lines; rows that share a
doc_id but not the text count as one document too, so they don't drop each other's lines; a null doc_id keeps all
its lines and takes part in nothing; an empty table gives no rows; further columns pass through untouched, whatever their names, but for those called
``__n_lines`` or ``__n_dropped``, whose place the counts take.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titerlake.llm.scratch import Scratch
from titerlake.llm.text import free_prefix, pick

BLANK = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]
#: Documents of a batch at most, and batches at least.
BATCH_DOCS, LEAST_BATCHES = 1 << 26, 4


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


class LineRuns:
    """Sorted runs of 128-bit line hashes in levels, each level ``fanout`` times as long as the one before."""

    def __init__(self, scratch: Scratch, fanout: int = 3):
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[list[DataFrame]] = []

    def seen(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        if not runs:
            return None
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def add(self, keys: DataFrame, level: int = 0) -> None:
        """Append a run of keys that no run has yet; a full level is compacted into one run of the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.scratch.save(keys.select(*_KEY).sortWithinPartitions(*_KEY), f"run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = full[0]
            for run in full[1:]:
                merged = merged.unionByName(run)
            self.add(merged.repartition(*[F.col(c) for c in _KEY]), level + 1)
            for run in full:
                self.scratch.drop(run)


def _batch_edges(rows: DataFrame, batches: int | None) -> list:
    """Inner boundaries of doc_id that deal the documents to about even batches, in ascending order."""
    if batches is None:
        batches = max(LEAST_BATCHES, math.ceil(rows.count() / BATCH_DOCS))
    if batches < 2:
        return []
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text deduplicated, plus ``__n_lines`` and ``__n_dropped``.

    Batches are ascending ranges of doc_id, so the first holder of a line is the smallest doc_id. Without ``batches``
    there are ``LEAST_BATCHES``, or as many as keep each at ``BATCH_DOCS`` documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    named = docs.select(*pick((id_col, "doc_id"), (text_col, "text"))).where(F.col("doc_id").isNotNull())
    edges = _batch_edges(named, batches)
    batch = F.lit(0)
    for edge in edges:
        batch = batch + F.when(F.col("doc_id") > F.lit(edge), 1).otherwise(0)
    each = named.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    each = each.where(F.length("key") >= min_chars)
    each = each.select(batch.alias("batch"), "doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    lines = scratch.save(each, "keys", partition_by="batch")

    store, parts = LineRuns(scratch, fanout), []
    for number in range(len(edges) + 1):
        now = lines.where(F.col("batch") == number).drop("batch")
        first = now.groupBy(*_KEY).agg(F.min("doc_id").alias("first"))
        seen = store.seen()
        if seen is not None:
            fresh = first.join(seen, _KEY, "left_anti")
        else:
            fresh = first
        fresh = scratch.save(fresh, "fresh")
        # a key that the runs already hold has no row in fresh: every line of it goes
        gone = now.join(fresh, _KEY, "left").where(F.col("first").isNull() | (F.col("first") < F.col("doc_id")))
        parts.append(scratch.save(gone.select("doc_id", "version", "pos"), "gone"))
        if number < len(edges):
            store.add(fresh)
        scratch.drop(fresh)
    gone = parts[0]
    for part in parts[1:]:
        gone = gone.unionByName(part)
    own = free_prefix([*docs.columns, "__n"])
    key = [own + "id", own + "version"]
    gone = gone.groupBy(F.col("doc_id").alias(key[0]), F.col("version").alias(key[1])).agg(F.collect_set("pos").alias(own + "gone"))

    identity, text = pick((id_col, "id"), (text_col, "text"))
    marked = docs.withColumns({key[0]: identity, key[1]: F.xxhash64(text), own + "lines": F.split(F.coalesce(text, F.lit("")), "\n")})
    joined = marked.join(gone, key, "left")
    gone_at = F.coalesce(own + "gone", F.array().cast("array<int>"))
    n = F.size(own + "lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), gone_at)
    kept = F.when(F.col(own + "gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(own + "lines", i)), "\n"))
    counts = {"__n_lines": n.cast("long"), "__n_dropped": F.size(gone_at).cast("long")}
    joined = joined.withColumns({text_col: kept} | counts)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c not in counts], *counts)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
    translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
    LATERAL (SELECT unnest(d.parts) AS line, unnest(range(len(d.parts))) AS pos) u
), firsts AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT l.doc_id, l.pos, l.line, f.first IS NOT NULL AND f.first < l.doc_id AS gone
  FROM lines l LEFT JOIN firsts f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
