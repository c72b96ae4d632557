"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again, so a lost
executor never loses an intermediate result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where the session has none (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="titerlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """A private folder of intermediate tables; ``drop`` frees a table that no later step reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/titerlake/{label}-{uuid.uuid4().hex}"
        self._serial = 0

    def path(self, name: str) -> str:
        self._serial += 1
        return f"{self.root}/{self._serial:04d}-{name}"

    def save(self, frame: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``frame`` and return it as read back. Its shuffle files go as soon as the table stands."""
        target = self.path(name)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            writer = frame.write
            if partition_by:
                writer = writer.partitionBy(partition_by)
            writer.parquet(target)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        back = self.spark.read.schema(frame.schema).parquet(target)
        back.scratch_path = target
        return back

    def drop(self, frame: DataFrame) -> None:
        remove(self.spark, frame.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
