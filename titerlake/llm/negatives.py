"""Hard negatives by norm-bucketed search.

The candidates of a shard are sorted by their norm, longest first, and cut into buckets. No score of a bucket exceeds the
product of the anchor's norm and the bucket's longest one (Cauchy-Schwarz), so once that falls below the lower limit of
an anchor's window, or below its running kth score, this bucket and all later ones are skipped. The first search
finds each anchor's positives, the second the negatives of each anchor and positive whose score lies in the window. Anchors
come in blocks, candidates in shards; a task holds one of each, and the best of all shards are ranked at the end.

Components become ``floor(SCALE * x)``, so scores are whole numbers: products of doubles where these hold them exactly,
of Python's integers where not (a score beyond a long becomes the nearest long).

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; of rows that share
an id the least (label, vector) counts; an empty vector scores 0 and a shorter one ends in zeros; ties go to the
smaller id; an anchor without others of its label, or a positive without rows in its window, gives no rows; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titerlake.llm.text import pick
from titerlake.llm.vectors import dealt, finite, longest, matrix, one_per_id

SHARD_ROWS, BLOCK_ANCHORS, BUCKET_ROWS, SCALE = 32768, 16384, 512, 256
#: Scores computed at once, about.
_CELLS = 1 << 20
_LONG = (-(2**63), 2**63 - 1)


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(vectors * scale)


class Best:
    """The running k best (score, id) of each query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.query, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(queries, _LONG[0], np.int64)  # the kth score, once there are k

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        query, score, id_ = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, id_)))
        order = np.lexsort([id_, ~score, query])  # ~ turns the order round and can't overflow
        query, score, id_ = query[order], score[order], id_[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[query[last]] = score[last]
        self.query, self.score, self.id = query[keep], score[keep], id_[keep]


class Buckets:
    """Candidates in buckets of falling norm."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, rows: int = BUCKET_ROWS):
        norms = np.sqrt((vectors * vectors).sum(1))
        order = np.lexsort([ids, -norms])
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.starts = np.arange(0, len(ids), rows)
        self.norms, self.rows = norms[order][self.starts], rows
        self.met = 0  # scores computed; the rest was skipped

    def scores(self, anchors: np.ndarray, bucket: int) -> np.ndarray:
        low = self.starts[bucket]
        part = self.vectors[low : low + self.rows]
        self.met += len(anchors) * len(part)
        size = float(np.abs(anchors).max(initial=0)) * float(np.abs(part).max(initial=0)) * max(1, part.shape[1])
        if size * 100 < 2**53:
            return (anchors @ part.T).astype(np.int64)
        big = np.array([[int(x) for x in r] for r in anchors], object) @ np.array([[int(x) for x in r] for r in part], object).T
        return np.clip(big, *_LONG).astype(np.int64)

    def search(self, anchors: np.ndarray, owner: np.ndarray, floors: np.ndarray, k: int, allowed) -> Best:
        """The k best candidates for each query; query i belongs to anchor ``owner[i]`` and takes scores from ``floors[i]`` on.

        ``allowed(queries, scores, ids, labels)`` says which cells count; ``queries`` and ``scores`` are rows of the block.
        """
        best = Best(len(owner), k)
        lengths = np.sqrt((anchors * anchors).sum(1))[owner] * (1 + 1e-9) + 1e-9
        active = np.arange(len(owner))
        for bucket in range(len(self.starts)):
            bound = lengths[active] * self.norms[bucket]
            active = active[(bound >= floors[active]) & (bound >= best.least[active])]
            if not len(active):
                break
            stop = self.starts[bucket] + self.rows
            ids, labels = self.ids[self.starts[bucket] : stop], self.labels[self.starts[bucket] : stop]
            step = max(1, _CELLS // self.rows)
            for low in range(0, len(active), step):
                queries = active[low : low + step]
                used, place = np.unique(owner[queries], return_inverse=True)
                scores = self.scores(anchors[used], bucket)[place]
                good = (scores >= best.least[queries][:, None]) & allowed(queries, scores, ids, labels)
                q, c = np.nonzero(good)
                if len(q):
                    best.add(queries[q], scores[q, c], ids[c])
        return best


def _within(score: np.ndarray, positive: np.ndarray, low: int, high: int) -> np.ndarray:
    """``low * positive <= 100 * score <= high * positive`` in whole numbers of any size."""
    if max(np.abs(score).max(initial=0), np.abs(positive).max(initial=0)) * max(100, low, high) < 2**62:
        return (low * positive <= 100 * score) & (100 * score <= high * positive)
    score, positive = score.astype(object), positive.astype(object)
    return ((low * positive <= 100 * score) & (100 * score <= high * positive)).astype(bool)


def _read(table: pa.Table, scale: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and whole vectors, one row for each id, and the rows they came from."""
    ids, labels, vectors = np.asarray(table["vec_id"], np.int64), np.asarray(table["label"], np.int64), matrix(table["embedding"], width)
    keep = one_per_id(ids, labels, vectors)
    return ids[keep], labels[keep], whole_numbers(vectors[keep], scale), keep


def _positive_search(k: int, scale: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        width = longest(candidates["embedding"], anchors["embedding"])
        ids, labels, vectors, _ = _read(candidates, scale, width)
        anchor_ids, anchor_labels, anchor_vectors, _ = _read(anchors, scale, width)

        def allowed(q, scores, ids, labels):
            return (anchor_labels[q][:, None] == labels) & (anchor_ids[q][:, None] != ids)

        n = len(anchor_ids)
        best = Buckets(ids, labels, vectors).search(anchor_vectors, np.arange(n), np.full(n, -np.inf), k, allowed)
        return pa.table([pa.array(anchor_ids[best.query]), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negative_search(k: int, scale: int, low: int, high: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        width = longest(candidates["embedding"], anchors["embedding"])
        ids, labels, vectors, _ = _read(candidates, scale, width)
        anchor_ids, anchor_labels, anchor_vectors, rows = _read(anchors, scale, width)
        positives = anchors["positives"].combine_chunks().take(pa.array(rows))
        owner = np.repeat(np.arange(len(rows)), np.diff(np.asarray(positives.offsets)))
        flat = positives.flatten()
        positive_ids, positive_scores = np.asarray(flat.field("positive_id")), np.asarray(flat.field("positive_score"))

        def allowed(q, scores, ids, labels):
            return (anchor_labels[owner[q]][:, None] != labels) & _within(scores, positive_scores[q][:, None], low, high)

        floors = np.where(positive_scores < 0, np.inf, low * positive_scores.astype(float) / 100 * (1 - 1e-9))  # a negative one's window is empty
        best = Buckets(ids, labels, vectors).search(anchor_vectors, owner, floors, k, allowed)
        q = best.query
        return pa.table(
            [pa.array(anchor_ids[owner[q]]), pa.array(positive_ids[q]), pa.array(positive_scores[q]), pa.array(best.id), pa.array(best.score)],
            names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
        )

    return run


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for all rows of ``anchors``.

    ``window`` bounds a negative's score in percent of the positive's. Both tables have the same columns, and anchors
    are rows of ``vectors``.
    """
    spark = vectors.sparkSession
    shards, blocks = max(1, math.ceil(vectors.count() / shard_rows)), max(1, math.ceil(anchors.count() / block_anchors))
    keys = ["shard", "block"]
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards * blocks, 100_000))

    def ready(frame: DataFrame) -> DataFrame:
        rows = frame.select(*pick((id_col, "vec_id"), (label_col, "label"), (vector_col, "embedding")))
        rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
        return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")

    def every(column: str, n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(column)

    def meet(candidates: DataFrame, wanted: DataFrame, search, shape: str) -> DataFrame:
        left = candidates.select("*", dealt("vec_id", shards, 11).alias("shard"), every("block", blocks))
        right = wanted.select("*", dealt("vec_id", blocks, 13).alias("block"), every("shard", shards))
        return left.repartition(spread, *keys).groupBy(*keys).cogroup(right.repartition(spread, *keys).groupBy(*keys)).applyInArrow(search, shape)

    candidates, wanted = ready(vectors), ready(anchors)
    found = meet(candidates, wanted, _positive_search(positives, scale), "anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= positives)
    lists = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # at most ``positives`` each
    pairs = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    mined = meet(candidates, wanted.join(lists, "vec_id"), _negative_search(negatives, scale, *window), pairs)
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    mined = mined.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", moved)
    return mine_hard_negatives(vectors, vectors.where(F.col("vec_id") % 100 == 0))


ORACLE_SQL = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY rank <= 10
"""
}
