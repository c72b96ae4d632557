"""Token-id files: documents encoded by a public tokenizer, coded in checksummed blocks, in ascending doc_id order.

A file set is a Parquet folder. Each row is a segment: the doc_ids and token counts of neighbouring documents, their
ids as coded by ``idcoder``, the number of the part it is in, and how many ids stand before it in that part. Documents
are dealt by ranges of doc_id, so parts in ascending order, and the rows within, ascend. Reading needs the sum of each
part, one number a file, to find where a segment starts; coded bytes are never shuffled.

Words between ASCII blanks, less a full stop or comma behind their last letter, are encoded once and put together
again: the tokenizer never joins characters across a blank, or a letter with the stop behind it.

Defined cases: null text counts as empty, so its document has the end id alone; equal doc_ids follow each other, by
text, null first; a null doc_id comes first; an empty table writes no segments; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titerlake.llm import idcoder
from titerlake.llm.scratch import Scratch
from titerlake.llm.text import buffers, filled, pick, slices, word_spans

END_ID, SEGMENT_BYTES = 1, 3 << 20
_SHAPE = "part int, inside long, doc_ids array<long>, counts array<long>, coded binary"
#: Distinct words whose ids a worker keeps, and words that are encoded in one call.
KNOWN, TOGETHER = 1 << 20, 512
#: Stands between words that are encoded in one call; it has one id of its own. Words that hold it are encoded alone.
BETWEEN = "|"


class WordEncoder:
    """Ids of whole texts, by way of their distinct words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.between,) = self._ids([BETWEEN])[0]
        self._forget()

    def _forget(self) -> None:
        """Words known: their hashes in order, and for each where its ids begin in ``pool`` and how many they are."""
        self.keys, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.array([END_ID], np.uint32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Encode words in joined groups and cut the ids at the separator."""
        mark = BETWEEN.encode()
        alone = [i for i, w in enumerate(words) if mark in w]
        odd = dict(zip(alone, self._ids([words[i].decode() for i in alone]), strict=True)) if alone else {}
        plain = [b"" if i in odd else w for i, w in enumerate(words)] if odd else words
        glue = b" " + mark + b" "
        joined = self._ids([glue.join(plain[i : i + TOGETHER]).decode() for i in range(0, len(plain), TOGETHER)])
        sizes, parts = [], []
        for ids in joined:
            cuts = np.flatnonzero(ids == self.between)
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            parts.append(np.delete(ids, cuts))
        size = np.concatenate(sizes)
        begin = np.cumsum(size) - size + len(self.pool)
        self.pool = np.concatenate([self.pool, *parts])
        for i, ids in odd.items():
            begin[i], size[i] = len(self.pool), len(ids)
            self.pool = np.concatenate([self.pool, ids])
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.begins, self.sizes = (np.concatenate(x)[order] for x in ((self.keys, keys), (self.begins, begin), (self.sizes, size)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id; and how many each has."""
        texts = filled(texts)
        hashes, offsets, starts, ends = word_spans(texts, lower=False, tails=True)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            raw = buffers(texts)[0].tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        at = np.searchsorted(self.keys, distinct)
        # the end id, at the pool's start, after each text's words
        order = np.insert(at[which], offsets[1:], len(self.keys))
        reach = np.append(self.sizes, 1)[order]
        until = np.cumsum(reach)
        ids = self.pool[np.arange(until[-1] if len(until) else 0) + np.repeat(np.append(self.begins, 0)[order] - (until - reach), reach)]
        last = until[offsets[1:] + np.arange(len(texts))]
        return ids, np.diff(np.concatenate([[0], last]))


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, with the words it knows."""
    return WordEncoder(path)


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode and write all documents below ``path``."""
    rows = docs.select(*pick((id_col, "doc_id"), (text_col, "text"))).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, inside = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, limit=SEGMENT_BYTES):
                ids, counts = encoder.encode(batch.column("text"))
                arrays = [pa.array([part], pa.int32()), pa.array([inside], pa.int64())]
                arrays += [pa.array([x], pa.list_(pa.int64())) for x in (batch.column("doc_id").to_pylist(), counts)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([idcoder.encode(ids)], pa.binary())], names=["part", "inside", "doc_ids", "counts", "coded"])
                inside += len(ids)

    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _SHAPE).write.parquet(path)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids array<long>``, decoded and checked block by block."""
    segments = spark.read.schema(_SHAPE).parquet(path)
    sums = segments.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # a row a file: no more than the driver lists anyway, so the window and the broadcast stay small
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("part", before.alias("base"))
    rows = segments.join(F.broadcast(bases), "part").select("doc_ids", "counts", "coded", (F.col("base") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, counts, coded, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = idcoder.decode(coded)
                ends = np.cumsum(counts)
                begins = ends - counts
                raw = ids.tobytes()
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(begins + start, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = Scratch(spark, "tokens").path("ids")
    write_token_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_ids(spark, path, with_ids=False)
