"""Quality rules: base statistics, and a calibrated logistic regression on hashed n-grams.

Features are hashed into ``BUCKETS`` weights: word unigrams and bigrams, and 3- and 5-grams of characters (code
points, case kept). A text's score is the bias plus, for each of these families, the mean weight of its
n-grams. The weights are fitted by full-batch gradient steps on at most ``TRAIN_ROWS`` labelled rows (those with the
smallest hash of doc_id), the probabilities calibrated by Platt scaling on further ``CALIBRATE_ROWS``. Scoring runs
in Arrow batches over whole texts; the verdict compares the probability with the fixed ``THRESHOLD``.

Defined cases: null text counts as empty; an empty text has the bias as its score; without labels of both kinds the
verdict is to keep; of repeated labels of a document the smallest counts, of repeated
rows of a labelled doc_id the least text; repeated rows give repeated results; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerlake.llm.text import buffers, filled, mixed, pick, slices, sums, word_hashes

BUCKETS, TRAIN_ROWS, CALIBRATE_ROWS, THRESHOLD = 1 << 18, 2400, 800, 0.5
SCALE = 8.0
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _windows(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows of ``width`` inside a text, and where each text's begin."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(starts[-1]) + np.repeat(offsets[:-1] - starts[:-1], counts)
    return at, starts


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text's begin."""
    data, ends = buffers(filled(texts))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, before[ends]


def feature_families(texts: pa.Array, words: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each n-gram family, and where each text's begin."""
    shift = np.uint64(64 - 18)
    out = [((words * np.uint64(0x9E3779B97F4A7C15)) >> shift, offsets)]
    at, starts = _windows(words, offsets, 2)
    out.append((((words[at] * np.uint64(3) + words[np.minimum(at + 1, max(len(words) - 1, 0))]) * np.uint64(0xD6E8FEB86659FD93)) >> shift, starts))
    points, ends = code_points(texts)
    for width, salt in ((3, 0xA0761D6478BD642F), (5, 0xE7037ED1A0B428DB)):
        at, starts = _windows(points, ends, width)
        n = max(len(points) - width + 1, 0)
        key = np.zeros(n, np.uint64)
        for k in range(width):
            key = key * np.uint64(0x9FB21C651E98DF25) + points[k : n + k]
        out.append((((key ^ (key >> np.uint64(32))) * np.uint64(salt) >> shift)[at], starts))
    return [(b.astype(np.int64), s) for b, s in out]


def scores(families: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(families[0][1]) - 1, bias)
    for bucket, starts in families:
        total += SCALE * sums(weights[bucket].astype(np.float64), starts) / np.maximum(np.diff(starts), 1)
    return total


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, n_train: int, steps: int = 60) -> QualityModel | None:
    """Adagrad on the first ``n_train`` rows, Platt scaling on the others; None without both kinds of labels."""
    if not 0 < labels[:n_train].sum() < len(labels[:n_train]):
        return None
    rows, cols, vals = [], [], []
    for low in range(0, len(texts), 64):  # few texts at a time keep the driver's memory small
        array = pa.array(texts[low : low + 64], pa.large_string())
        for bucket, starts in feature_families(array, *word_hashes(array, lower=False)):
            n = np.diff(starts)
            keys, times = np.unique(np.repeat(np.arange(len(n)), n) * BUCKETS + bucket, return_counts=True)
            at = keys // BUCKETS
            rows.append((low + at).astype(np.int32))
            cols.append((keys % BUCKETS).astype(np.int32))
            vals.append((SCALE * times / n[at]).astype(np.float32))
        if low < n_train <= low + 64:  # the texts of this group that calibrate are told apart below
            edge = len(rows)
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    stop = sum(map(len, rows[:edge]))
    first = row[:stop] < n_train
    y = labels[:n_train].astype(float)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, grown, bias, bias_grown = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0, 1e-8
    r, c, v = row[:stop][first], col[:stop][first], val[:stop][first]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, v * w[c], n_train) + bias, -30, 30)))
        error = balance * (p - y) / n_train
        slope = np.bincount(c, v * error[r], BUCKETS) + 1e-6 * w
        grown += slope * slope
        bias_grown += error.sum() ** 2
        w -= 0.2 * slope / np.sqrt(grown)
        bias -= 0.2 * error.sum() / np.sqrt(bias_grown)
    weights = w.astype(np.float32)
    s = np.bincount(row, val * w[col], len(texts)) + bias
    held, truth = (s[n_train:], labels[n_train:]) if len(set(labels[n_train:])) == 2 else (s, labels)
    a, b = 1.0, 0.0
    # Platt's smoothed targets keep the fit finite when the classes part cleanly
    n1, n0 = truth.sum(), len(truth) - truth.sum()
    target = np.where(truth == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * held + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * held * held).sum() + 1e-6, (h * held).sum()], [(h * held).sum(), h.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, [(g * held).sum(), g.sum()])
    return QualityModel(weights, bias, float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> QualityModel | None:
    """Fit on at most ``train_rows + calibrate_rows`` labelled documents, which the driver gets."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows + calibrate_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by the two parameters
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.coalesce("text", F.lit(""))).alias("text"))  # one text an id
    found = rows.select("*", F.xxhash64("doc_id").alias("h")).toPandas().sort_values(["h", "doc_id"])
    if found.empty:
        return None
    n_train = max(1, round(len(found) * train_rows / (train_rows + calibrate_rows)))
    return fit(found["text"].tolist(), found["quality"].to_numpy(), n_train)


def _repeats(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, words that lie in a 3-word window found twice or more in the text."""
    at, starts = _windows(words, offsets, 3)
    out = np.zeros(len(offsets) - 1, np.int64)
    if not len(at):
        return out
    key = (words[at] * np.uint64(0x9E3779B97F4A7C15) + words[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + words[at + 2]
    # equal windows of different texts get different keys
    key = mixed(key ^ mixed(np.repeat(np.arange(len(out), dtype=np.uint64), np.diff(starts))))
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    again = np.zeros(len(k), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = at[order[again]]
    covered = np.zeros(len(words), np.int64)
    for step in range(3):
        covered[hit + step] = 1
    return sums(covered, offsets)


def statistics(texts: pa.Array, words: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    data, ends = buffers(texts)
    starts_char = (data & 0xC0) != 0x80
    lines = []
    for raw in texts.cast(pa.large_binary()).to_pylist():
        seen: set[bytes] = set()
        again = 0
        for line in raw.split(b"\n"):
            if line in seen:
                again += 1
            elif line.strip(b" \t\n\x0b\x0c\r"):
                seen.add(line)
        lines.append(again)
    return {
        "n_words": np.diff(offsets),
        "word_chars": sums((starts_char & ~_BLANK[data]).astype(np.int64), ends),
        "n_symbols": sums(_SYMBOL[data], ends),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": _repeats(words, offsets),
    }


def score_quality(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, the calibrated ``probability`` (null without a model) and ``kept`` for every row."""
    rows = docs.select(*pick((id_col, "doc_id"), (text_col, "text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole):
                texts = filled(batch.column("text"))
                words, offsets = word_hashes(texts, lower=False)
                stats = statistics(texts, words, offsets)
                failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
                if model is None:
                    chance, good = pa.nulls(len(failed), pa.float64()), ~failed
                else:
                    p = model.probability(scores(feature_families(texts, words, offsets), model.weights, model.bias))
                    chance, good = pa.array(p), ~failed & (p >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in stats.values()], pa.array(failed), chance, pa.array(good)],
                    names=["doc_id", *stats, "base_failed", "probability", "kept"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, train(docs, labels)).drop("probability")
