"""Corpus preparation: language ID, line dedup, near-duplicate removal, source mixing, packing.

Each stage gets what the one before kept, as a DataFrame over its Parquet files, and all but the last return the
columns of ``documents``. Stage 4 keeps every row and writes them in the order of the mix; stage 5 packs runs of
neighbouring rows of those files, so the mix decides which documents share a sequence.

All stages: an empty table gives an empty one; columns beyond those of ``documents`` pass through, whatever their names,
up to packing, which returns its own; very long texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerlake.llm import jaccard, language, lines, mixing, packing
from titerlake.llm.scratch import Scratch

#: Documents whose best language holds less than this share of their n-grams are in none of the languages learned.
LEAST_LANGUAGE_SHARE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the others go.

    Null and empty texts, and those without a letter, are in no language and go; repeated rows go or stay together; a
    null doc_id or source doesn't matter; documents with a null lang are judged but teach nothing; of languages that
    hold equal shares the first by name counts.
    """
    model = language.train(docs.select("doc_id", "text", "lang"))
    return language.keep_known(docs, model, LEAST_LANGUAGE_SHARE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by an earlier document go, and with them documents of which no word is left.

    Null and empty texts lose nothing and stay, null as empty; rows that share a doc_id count as one document and lose
    the same lines; a null doc_id keeps all its lines; lines of under ten characters stay everywhere.
    """
    out = lines.dedup_lines(docs)
    emptied = (F.col("__n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~emptied).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at similarity 0.8, the smallest doc_id stays.

    Null and empty texts are linked with nothing and stay, and so do rows of a null doc_id; rows that share a doc_id go
    or stay together.
    """
    groups = jaccard.jaccard_components(docs, k=5, percent=80)
    copies = groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files ordered by the mix of sources at their tempered weights.

    A null source is a source like others; a null or empty text counts one character; repeated rows all stay.
    """
    return mixing.mix_sources(docs).orderBy("__slot", "__start", "doc_id").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 words, filled from neighbours in the mix; ``docs`` must be read from files.

    A null or empty text has size 1; a long one fills whole sequences and its rest is packed like others; repeated rows
    are packed one by one, never two copies in a sequence; a null source is one source, a null doc_id is kept.
    """
    return packing.pack_documents(docs, in_file_order=True)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: The classifier of the first stage and the packing have no SQL; tests/llm/test_cases.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
