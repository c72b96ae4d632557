"""Streaming ingestion with content-hash dedupe, and gauges over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerlake.operators.linkage import first_by_key


def ingest_folder(spark: SparkSession, folder: str, ledger: str, checkpoint: str) -> None:
    """Read new files of ``folder`` once, append those whose content the ledger doesn't hold, and stop.

    The checkpoint knows the paths seen; the ledger (Parquet) knows the contents.
    """
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(shape).format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select("path", "length", F.sha2("content", 256).alias("content_hash"))

    def append(batch: DataFrame, number: int) -> None:
        fresh = first_by_key(batch, ["content_hash"], [F.col("path")])
        try:
            seen = spark.read.parquet(ledger).select("content_hash")
            fresh = fresh.join(seen, "content_hash", "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        fresh.withColumn("batch", F.lit(number)).write.mode("append").parquet(ledger)

    named.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rate_windows(events: DataFrame, limit: int = 5) -> DataFrame:
    """Events per key and minute; ``limited`` where they pass the limit. Works on a stream with a watermark too."""
    counts = events.groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").alias("minute"), "n", (F.col("n") > limit).alias("limited"))


def gauges(obs: DataFrame) -> DataFrame:
    """Rows by status and disease, the aggregate that a periodic trigger refreshes."""
    return obs.groupBy("review_status", "disease").agg(F.count("*").alias("n"))
