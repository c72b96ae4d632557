"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only in a local session that names none, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="evidence-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Tables:
    """Written tables of one job. Each is computed once, cuts the lineage, and outlives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.serial = spark, f"{shared_folder(spark)}/evidence/{label}-{uuid.uuid4().hex}", 0

    def write(self, frame: DataFrame, *by: str) -> DataFrame:
        """``frame`` written and read back, with a folder for each value of ``by``, the last columns, if given."""
        self.serial += 1
        path = f"{self.root}/{self.serial:04d}"
        frame.write.partitionBy(*by).parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        back.table_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(frame.table_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
