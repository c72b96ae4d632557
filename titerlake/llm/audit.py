"""Filter interaction audit: what each of five filters removes under every order of application.

A document's failing filters are five bits. ``FIRST`` holds, for each of the 32 combinations and each of the 120 orders,
the step that removes a document; a batch's documents are looked up there at once and counted by part, order, step and
label. The other figures follow from the removals and the counts of failures, and all of them are sums, so tasks
emit partial arrays for the parts they met, and Spark adds these up.

Copies are found first: each text's digest keeps its smallest doc_id, and a row that isn't it fails the last filter. Only
ids, digests and bits are shuffled, never texts.

Defined cases: null text counts as empty; a null source is the part ''; a row of a null doc_id is no copy, and has no
label; rows that share doc_id and text aren't copies of each other; repeated rows all count; a document is good (toxic)
if any of its labels says so; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerlake.llm.scratch import Scratch
from titerlake.llm.text import pick

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_STEPS = len(FILTERS)
#: The filter at each step of each order.
AT = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
#: For each set of failing filters and each order the step (from 0) that removes, ``_STEPS`` where none fails.
FIRST = np.array([[next((k for k, f in enumerate(order) if mask >> f & 1), _STEPS) for order in AT] for mask in range(1 << _STEPS)])
FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
#: Parts whose arrays a task holds at once.
HELD_PARTS = 256
_CAPITAL = re.compile(rb"[A-Z]")
_MARK = re.compile(rb"[#$%&*|]")
_COPY = 1 << FILTERS.index("E")


def text_bits(raw: bytes) -> int:
    """Bits of the filters that a text alone decides."""
    words = raw.split()  # of bytes: splits at [\x20\x09-\x0D]
    points = len(raw) if raw.isascii() else len(raw.decode())
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * len(_CAPITAL.findall(raw)) > 5 * points) << 2
        | (_MARK.search(raw) is not None) << 3
    )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, bits, digest`` for every row."""
    rows = docs.select(*pick((id_col, "doc_id"), (text_col, "text"), (part_col, "part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, digests = [], []
            for text in batch.column("text"):
                raw = (text.as_buffer() or pa.py_buffer(b"")).to_pybytes() if text.is_valid else b""
                bits.append(text_bits(raw))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "bits", "digest"])

    rows = rows.select("doc_id", "text", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, part string, bits int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """Set the bit of each row whose text a smaller doc_id has too."""
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # joined by doc_id and digest: the copies of one text are rows of many keys, never one hot key
    marked = rows.join(firsts, ["doc_id", "digest"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return marked.withColumn("bits", F.when(copy, F.col("bits").bitwiseOR(F.lit(_COPY))).otherwise(F.col("bits"))).drop("first")


def partial_figures(part: np.ndarray, bits: np.ndarray, good: np.ndarray, toxic: np.ndarray, parts: int) -> np.ndarray:
    """Long array [part, figure, order, step] of a batch."""
    cells = parts * len(ORDERS) * (_STEPS + 1)
    place = ((part[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (_STEPS + 1) + FIRST[bits]).ravel()

    def removals(weight: np.ndarray) -> np.ndarray:
        chosen = np.repeat(weight, len(ORDERS))
        return np.bincount(place[chosen], minlength=cells).reshape(parts, len(ORDERS), _STEPS + 1)

    removed = removals(np.ones(len(bits), bool))
    fails = np.stack([np.bincount(part[bits >> f & 1 == 1], minlength=parts) for f in range(_STEPS)], 1)
    alone = np.stack([np.bincount(part[bits == 1 << f], minlength=parts) for f in range(_STEPS)], 1)
    shapley = np.zeros((parts, _STEPS), np.int64)
    for f in range(_STEPS):
        shapley[:, f] = removed[:, :, :_STEPS][:, AT == f].sum(1)
    gone = removed[:, :, :_STEPS]
    kept = removed.sum(2)[:, :, None] - np.cumsum(gone, 2)
    return np.stack([kept, gone, fails[:, AT] - gone, alone[:, AT], removals(good)[:, :, :_STEPS], removals(toxic)[:, :, :_STEPS], shapley[:, AT]], 1)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, filter_order, step`` and the long ``FIGURES``: all orders and steps for every part."""
    spark = docs.sparkSession
    rows = with_copies(Scratch(spark, "audit").save(judged(docs, id_col, text_col, part_col), "judged"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(known, "doc_id", "left").select("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    cells = len(ORDERS) * _STEPS
    kind = rows.schema["part"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            values = np.stack(list(held.values()), 1) if held else np.zeros((len(FIGURES), 0, cells), np.int64)
            names = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), cells)))
            place = pa.array(np.tile(np.arange(cells), len(held)), pa.int32())
            return pa.RecordBatch.from_arrays([names, place, *[pa.array(v.ravel(), pa.int64()) for v in values]], names=["part", "cell", *FIGURES])

        for whole in batches:
            for low in range(0, whole.num_rows, 1024):  # few rows at a time have few parts
                batch = whole.slice(low, 1024)
                names = batch.column("part").dictionary_encode()
                bits, good, toxic = (np.asarray(batch.column(c)) for c in ("bits", "good", "toxic"))
                figures = partial_figures(np.asarray(names.indices, np.int64), bits, good, toxic, len(names.dictionary))
                for name, values in zip(names.dictionary.to_pylist(), figures.reshape(len(names.dictionary), len(FIGURES), cells), strict=True):
                    held[name] = held[name] + values if name in held else values.copy()
                    if len(held) >= HELD_PARTS:
                        yield out()
                        held.clear()
        yield out()

    partial = rows.mapInArrow(run, f"part {kind}, cell int, " + ", ".join(f"{name} long" for name in FIGURES))
    total = partial.groupBy("part", "cell").agg(*[F.sum(name).alias(name) for name in FIGURES])
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.floor(F.col("cell") / _STEPS) + 1).cast("int"))
    return total.select("part", order.alias("filter_order"), (F.col("cell") % _STEPS + 1).cast("int").alias("step"), *FIGURES)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return filter_audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = {
    "op13_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)
), g AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
), o AS (
  SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e
  FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i), range(1, 6) e(i)
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT [a, b, c, d, e] AS seq, 'ABCDE'[a] || 'ABCDE'[b] || 'ABCDE'[c] || 'ABCDE'[d] || 'ABCDE'[e] AS filter_order, u.step AS step, [a, b, c, d, e][u.step] AS filter
  FROM o, range(1, 6) u(step)
), x AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails[filter] AS bad,
    len(list_filter(fails, lambda v: v)) = 1 AS single,
    coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: fails[seq[k]])), 6) AS first
  FROM g, s
), t AS (
  SELECT part, filter_order, step, filter,
    sum(n) FILTER (first > step) AS kept, sum(n) FILTER (first = step) AS removed, sum(n) FILTER (bad AND first < step) AS redundant,
    sum(n) FILTER (bad AND single) AS unique_fails, sum(n) FILTER (first = step AND good) AS good_lost, sum(n) FILTER (first = step AND toxic) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley
FROM t
"""
}
