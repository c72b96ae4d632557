"""Mixing sources to target weights by Pfair scheduling.

A source's documents form one stream in hash order, cut into blocks of ``block_chars`` characters. With weights in
whole slots ``q`` out of ``slots`` a round, block k (from 1) of a source is released at ``floor((k-1) * slots / q)``
and due at ``ceil(k * slots / q)``; earliest deadline first, one block a slot, keeps every source within less than one
block of its target at every slot, for as long as it has blocks. One round of that schedule is computed once (at
most ``slots`` rows, the only broadcast) and holds for all rounds, so a block's slot follows from its number. Streams
are numbered in salted parts, so a source with a third of all rows isn't one task's work. Slots of a source that has
run out stay empty; nothing is dropped or repeated.

A row's hash is that of its id, source, text (where there is one) and size, so rows of one doc_id, or of none, are dealt out too, and
columns that only pass through change no slot; they order rows that are equal otherwise.

Defined cases: a null source is the source ''; a null or empty text counts one character; a null doc_id is like any
other; repeated rows are kept and follow each other; weights for sources that don't occur are ignored, sources without a
weight (or with one of zero or less) get the smallest share, one slot; an empty table gives no rows; further columns
pass through, whatever their names, but for those called ``__block``, ``__slot`` or ``__start``, whose place the
results take.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titerlake.llm.text import free_prefix, pick

SLOTS, BLOCK_CHARS, PART_ROWS, TEMPERATURE = 1000, 1 << 16, 8192, 0.7


def slot_counts(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Whole slots for each source, one at least, by largest remainder; the sum is ``slots``, or more for many sources."""
    slots = max(slots, 2 * len(weights))
    usable = {s: max(w, 0.0) for s, w in weights.items()}
    total = sum(usable.values()) or 1.0
    exact = {s: w / total * slots for s, w in usable.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))
    for k in range(max(0, slots - sum(out.values()))):
        out[by_rest[k % len(by_rest)]] += 1
    while sum(out.values()) > slots:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def pfair_round(counts: dict[str, int]) -> list[tuple[str, int]]:
    """For each slot of one round, the source and the number of its block, by earliest deadline first."""
    slots = sum(counts.values())
    waiting = [(0, s, 0) for s in sorted(counts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for now in range(slots):
        while waiting and waiting[0][0] <= now:
            _, source, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * slots // counts[source]), source, k))
        _, source, k = heapq.heappop(ready)
        out.append((source, k))
        if k + 1 < counts[source]:
            heapq.heappush(waiting, ((k + 1) * slots // counts[source], source, k + 1))
    return out


def tempered_weights(sizes: dict[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    return {s: max(n, 1) ** temperature for s, n in sizes.items()}


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    slots: int = SLOTS,
    block_chars: int = BLOCK_CHARS,
    part_rows: int = PART_ROWS,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size=None,
) -> DataFrame:
    """All rows and columns of ``docs``, plus ``__block``, ``__slot`` and ``__start`` (characters before it in its source).

    Sorted by (``__slot``, ``__start``) the rows are the mix. Without ``weights`` they are the sizes to the power 0.7.
    """
    spark = docs.sparkSession
    own = free_prefix([*docs.columns, "__block"])
    src, key, chars, tie, part, k, at, quota, inside, offset = (own + c for c in ("source", "hash", "size", "tie", "part", "k", "at", "quota", "inside", "offset"))
    identity, source = pick((id_col, "id"), (source_col, "source"))
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    texts = pick((text_col, "text")) if text_col in docs.columns else []
    length = size if size is not None else F.length(*texts)
    rows = docs.withColumns({src: F.coalesce(source.cast("string"), F.lit("")), chars: F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long"), tie: whole})
    rows = rows.withColumn(key, F.xxhash64(identity, src, chars, *texts))
    per_source = rows.groupBy(src).agg(F.sum(chars).alias("size"), F.count("*").alias("n")).collect()  # a row a source
    sizes = {r[src]: r["size"] for r in per_source}
    parts = max(1, math.ceil(sum(r["n"] for r in per_source) / part_rows))
    rows = rows.withColumn(part, F.pmod(F.xxhash64(key, F.lit(3)), F.lit(parts)))
    if weights is None:
        weights = tempered_weights(sizes)
    counts = slot_counts({s: weights.get(s, 0.0) for s in sizes}, slots) if sizes else {}
    round_ = pfair_round(counts)
    plan = spark.createDataFrame([(s, n, i, counts[s]) for i, (s, n) in enumerate(round_)], f"{src} string, {k} long, {at} long, {quota} long")

    before = W.partitionBy(src).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(src, part).agg(F.sum(chars).alias("sum"))
    offsets = offsets.select(src, part, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias(offset))
    within = W.partitionBy(src, part).orderBy(key, identity, chars, tie).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(inside, F.coalesce(F.sum(chars).over(within), F.lit(0))).join(offsets, [src, part])
    rows = rows.withColumn("__start", F.col(offset) + F.col(inside)).withColumn("__block", F.floor(F.col("__start") / block_chars))
    rows = rows.join(F.broadcast(plan.select(src, quota).distinct()), src).withColumn(k, F.col("__block") % F.col(quota))
    rows = rows.join(F.broadcast(plan.drop(quota)), [src, k])
    rows = rows.withColumn("__slot", F.floor(F.col("__block") / F.col(quota)) * len(round_) + F.col(at))
    out = ["__block", "__slot", "__start"]
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in out], *out)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.length("text").alias("chars"))
    out = mix_sources(docs, size=F.col("chars"))
    return out.select("doc_id", "source", "chars", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__start").alias("start"))
