"""Language identification with language-bitmask n-gram filters.

Training counts byte 4-grams of ASCII-lower-cased texts per language over a bounded sample (``SAMPLE_PER_LANG``
labelled rows a language, those with the smallest hash of doc_id) and keeps the ``GRAMS`` commonest of each. They go
into one bit-sliced Bloom filter: a row of bits, one for each language, at every slot; ANDing the rows at an
n-gram's ``HASHES`` slots returns all languages that hold it at once. For a text, per-language hits are popcounted
over its n-grams, and corrected for false positives with the fill of that language's bit column:
``(hits / n - fpr) / (1 - fpr)``, clamped to 0..1. The language with the largest share wins, the first by name on ties.

Defined cases: null text, or one without a letter, is ``und`` with score 0; so is all if nothing was learned; a text
under two bytes still has one n-gram, as texts are padded with a blank on both sides; repeated rows give repeated
results; a null doc_id counts as not held out and is not learned from; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titerlake.llm.text import buffers, filled, mixed, pick, slices, sums

SAMPLE_PER_LANG, GRAMS, SLOTS, HASHES = 1500, 4096, 1 << 17, 2
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32  # A-Z to a-z


def gram_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All byte 4-grams of each text, lower-cased and padded, as numbers; and where each text's begin."""
    padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), filled(texts), pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string()))
    data, offsets = buffers(padded)
    wide = _FOLD[data]
    codes = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:] if len(wide) >= 4 else np.zeros(0, np.uint32)
    # windows that start in the last three bytes of a text would run into the next one
    keep = np.ones(len(codes), bool)
    for back in (1, 2, 3):
        at = offsets[1:] - back
        keep[at[(at >= 0) & (at < len(codes))]] = False
    lengths = np.maximum(np.diff(offsets) - 3, 0)
    return codes[keep], np.concatenate([[0], np.cumsum(lengths)])


def _slots(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    spread = mixed(codes.astype(np.uint64))
    return [((spread >> np.uint64(24 * k)) % np.uint64(slots)).astype(np.int64) for k in range(HASHES)]


class LanguageFilter:
    """Bit-sliced Bloom filter; 64 languages to a word, more words for more languages."""

    def __init__(self, grams: dict[str, list[int]], slots: int = SLOTS):
        self.languages = sorted(grams)
        self.rows = np.zeros((max(1, -(-len(grams) // 64)), slots), np.uint64)
        for bit, language in enumerate(self.languages):
            for at in _slots(np.array(grams[language], np.uint64), slots):
                self.rows[bit // 64][at] |= np.uint64(1 << bit % 64)
        fill = [np.count_nonzero(self.rows[b // 64] & np.uint64(1 << b % 64)) / slots for b in range(len(self.languages))]
        self.false_rate = np.array(fill) ** HASHES

    def shares(self, texts: pa.Array) -> np.ndarray:
        """Corrected share of each text's n-grams in each language, ``float[texts, languages]``."""
        codes, offsets = gram_codes(texts)
        n = np.maximum(np.diff(offsets), 1)
        out = np.zeros((len(texts), len(self.languages)))
        at = _slots(codes, self.rows.shape[1])
        for word, rows in enumerate(self.rows):
            masks = rows[at[0]]
            for more in at[1:]:
                masks &= rows[more]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                hits = sums((masks >> np.uint64(bit)) & np.uint64(1), offsets)
                out[:, 64 * word + bit] = hits / n
        return np.clip((out - self.false_rate) / (1 - self.false_rate), 0, 1)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                codes, n = np.unique(gram_codes(batch.column("text").filter(pa.array(langs == lang)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def train(rows: DataFrame, per_language: int = SAMPLE_PER_LANG, grams: int = GRAMS) -> LanguageFilter:
    """Fit on ``doc_id, text, lang``. The driver gets ``grams`` numbers for each language, no text."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    totals = rows.groupBy("lang").agg(F.count("*").alias("total"))
    # about per_language rows of each language, by hash: no ordering over a whole language is needed
    part = F.greatest(F.lit(1), F.floor(F.col("total") / per_language))
    # a row per language, fewer than the model itself holds: texts are not dealt out by language
    sample = rows.join(F.broadcast(totals), "lang").where(F.pmod(F.xxhash64("doc_id"), part) == 0).select("lang", "text")
    counts = sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= grams)
    learned: dict[str, list[int]] = {}
    for row in top.select("lang", "gram").collect():
        learned.setdefault(row["lang"], []).append(row["gram"])
    return LanguageFilter(learned)


def predict(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    rows = docs.select(*pick((id_col, "doc_id"), (text_col, "text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole):
                shares = model.shares(batch.column("text"))
                letters = [t is not None and any(map(str.isalpha, t)) for t in batch.column("text").to_pylist()]
                known = np.array(letters, bool) & bool(model.languages)
                best = shares.argmax(1) if model.languages else np.zeros(len(known), int)
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, shares[np.arange(len(best)), best], 0.0) if model.languages else np.zeros(len(known))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageFilter, least: float) -> DataFrame:
    """All columns of the rows whose ``text`` has a letter and a language with a share of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole):
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in batch.column("text").to_pylist()], bool)
                if model.languages:
                    letters &= model.shares(batch.column("text")).max(1) >= least
                yield batch.filter(pa.array(letters))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id) -> F.Column:
    """Remainder of the document's fold: crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id")) != 0))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
