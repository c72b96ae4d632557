"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents are dealt into windows of at most about ``window_rows``; each window is packed by one task, largest piece
first. Open bins are kept in order of residual capacity, each with a bitmap of its sources and of its duplicate
clusters. For a piece, the search starts at the tightest residual that fits and goes on to its successors until a bin
without one of the piece's bits is found, else a new bin is opened: no bin holds two documents of a source, or two
copies of a text.

Windows come from a hash of doc_id, source, text and, among equal rows, their number, so the packing is the same however the
input is split, and rows that share a doc_id, or have none, are dealt out like others; or (``in_file_order``) they are runs of neighbouring rows of the Parquet files that ``docs`` must be read
from, so that an order written before, such as a mix of sources, decides which documents can share a bin. A bin belongs
to one window, so copies in different windows can't meet in a bin either. Sizes and keys alone are shuffled, never texts.

Defined cases: a size is the words of the text plus one for the end mark, so null and empty texts have size 1; a
document longer than ``capacity`` fills whole bins of its own and its rest is packed like others; a null source is
one source; equal texts are one cluster; repeated rows are packed one by one; ties are packed by doc_id, nulls first;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerlake.llm.text import pick

CAPACITY, WINDOW_ROWS = 2048, 4096


def best_fit(items: list[tuple[int, str | None, int]], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Pack ``(size, source, cluster)``; for each item its pieces as (piece, bin, offset, length)."""
    sources: dict[str | None, int] = {}
    seen: dict[int, int] = {}
    clusters: dict[int, int] = {}
    for _, source, cluster in items:
        sources.setdefault(source, len(sources))
        seen[cluster] = seen.get(cluster, 0) + 1
        if seen[cluster] == 2:  # a text that is alone can't conflict
            clusters[cluster] = len(clusters)
    shift = len(sources)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in items]
    bins: list[int] = []  # bitmaps
    free: list[tuple[int, int]] = []  # (residual, bin), ascending
    rest = []
    for i, (size, source, cluster) in enumerate(items):
        bits = 1 << sources[source] | (1 << shift + clusters[cluster] if cluster in clusters else 0)
        whole, left = divmod(size, capacity)
        for piece in range(whole):
            out[i].append((piece, len(bins), 0, capacity))
            bins.append(bits)
        if left:
            rest.append((-left, i, whole, bits))
    for minus, i, piece, bits in sorted(rest):
        size = -minus
        at = bisect_left(free, (size, -1))
        while at < len(free) and bins[free[at][1]] & bits:
            at += 1
        if at < len(free):
            residual, number = free.pop(at)
        else:
            residual, number = capacity, len(bins)
            bins.append(0)
        bins[number] |= bits
        out[i].append((piece, number, capacity - residual, size))
        if residual > size:
            insort(free, (residual - size, number))
    return out


def _window_packer(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "cluster", "size", "source")), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3] or ""))
        packed = best_fit([(size, source, cluster) for _, cluster, size, source in rows], capacity)
        flat = [(row[0], *piece) for row, pieces in zip(rows, packed, strict=True) for piece in pieces]
        columns = list(zip(*flat, strict=True)) or [[]] * 5
        arrays = [pa.array(c, pa.int64()) for c in columns]
        arrays[1:1] = [pa.array([k.as_py()] * len(flat), pa.int64()) for k in key]
        return pa.table(arrays, names=["doc_id", "file", "window", "piece", "bin", "bin_offset", "length"])

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, window_rows: int = WINDOW_ROWS, in_file_order: bool = False) -> DataFrame:
    """``doc_id, file, window, piece, bin, bin_offset, length``: one row per piece; (file, window, bin) is a sequence."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
    columns = [*pick(("doc_id", "doc_id"), ("source", "source")), F.xxhash64("text").alias("cluster"), size.alias("size")]
    if in_file_order:
        part = F.try_to_number(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), F.lit("999999999")).cast("long")
        other = F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1 << 60)) + (1 << 40)  # beyond all part numbers
        rows = docs.select(*columns, F.coalesce(part, other).alias("file"), F.floor(F.col("_metadata.row_index") / window_rows).alias("window"))
    else:
        windows = max(1, math.ceil(docs.count() / window_rows))
        # equal rows are counted, then numbered, so the deal follows from the rows alone and copies spread over the windows
        rows = docs.select(*columns).groupBy("doc_id", "source", "cluster", "size").agg(F.count("*").cast("int").alias("copies"))
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        deal = F.pmod(F.xxhash64("doc_id", "source", "cluster", "size", "copy"), F.lit(windows))
        rows = rows.select("doc_id", "source", "cluster", "size", F.lit(0).cast("long").alias("file"), deal.alias("window"))
    shape = "doc_id long, file long, window long, piece long, bin long, bin_offset long, length long"
    return rows.groupBy("file", "window").applyInArrow(_window_packer(capacity), shape)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return pack_documents(docs)
