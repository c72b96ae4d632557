"""Dataset snapshots: numbers in a global order, a hash that doesn't depend on partitions, exports, and results kept by what they saw."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titerlake.operators.merging import Store
from titerlake.sources.shared import Tables

#: Facts of one snapshot at most, and columns of an exported dataset with their meaning (fixed values).
MOST_FACTS = 50_000
DICTIONARY = (
    ("dp_id", "string", "number of the fact in this dataset"), ("disease", "string", "standard name of the disease"), ("province", "string", "standard name of the province"), ("city", "string", "city, if named"),
    ("data_type", "enum", "seroprevalence or gmc"), ("value", "float", "percent, or concentration"), ("sample_size", "integer", "people tested"), ("age_min", "integer", "lower bound of age"),
    ("age_max", "integer", "upper bound of age"), ("population", "string", "group of people"), ("collection_year", "integer", "year of sampling"), ("assay", "string", "type of antibody"),
    ("estimate_type", "enum", "primary or subgroup"), ("confidence", "enum", "high, medium or low"), ("literature_title", "string", "title of the source"), ("literature_year", "integer", "year of the source"),
)


def numbered(frame: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``frame`` with ``name``: 1, 2, 3 and so on in the order of ``order``, counted in parallel.

    Rows are sorted in ranges and written; a range's rows count on from the sum of the ranges before it, which is a row for
    each range. Rows that ``order`` doesn't tell apart keep some order; order by a key for one that repeats.
    """
    ranged = frame.repartitionByRange(partitions, *order) if partitions else frame.repartitionByRange(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = Tables(frame.sparkSession, "numbered").write(ranged.sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_place": within}))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def canonical(value: Column, kind: str = "double") -> Column:
    """A value as a text that is the same wherever it is written: whole millionths for doubles, 1 or 0 for truth, ``null``."""
    text = F.floor(value * 1e6 + 0.5).cast("string") if kind in ("double", "float") else F.when(value, "1").otherwise("0") if kind == "boolean" else value.cast("string")
    return F.when(value.isNull(), "null").otherwise(text)


def canonical_params(params: dict) -> str:
    """Parameters that say something, as JSON with sorted keys: equal ones give equal texts."""
    return json.dumps({k: v for k, v in params.items() if v is not None}, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def data_hash(facts: DataFrame, id_col: str = "fact_id") -> DataFrame:
    """One row: ``n`` and ``data_hash``, 16 hex digits of the facts' ids, states and values, whatever their order or partitions.

    Rows are hashed alone, their digests joined in the order of ids within 4096 parts (by the id's own digest), and the parts'
    digests joined in the order of parts; a part holds a 4096th of the rows' digests.
    """
    row = F.concat_ws(",", F.col(id_col).cast("string"), F.coalesce("review_status", F.lit("")), canonical(F.col("value")))
    rows = facts.select(F.substr(F.sha2(F.col(id_col).cast("string"), 256), F.lit(1), F.lit(3)).alias("part"), F.col(id_col).cast("string").alias("id"), F.sha2(row, 256).alias("d"))
    parts = rows.groupBy("part").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "d"))), lambda x: x["d"]), ""), 256).alias("d"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: F.concat(x["part"], x["d"])), "")  # 4096 parts at most
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.substr(F.sha2(whole, 256), F.lit(1), F.lit(16)).alias("data_hash"))


def snapshot_facts(facts: DataFrame, sources: DataFrame, most: int = MOST_FACTS, order: tuple[str, ...] = ("fact_id",)) -> DataFrame:
    """Approved primary facts, the first ``most`` by ``order``, with title and year of their source, numbered ``dp_0001`` and on in that order."""
    kept = facts.where((F.col("review_status") == "approved") & (F.col("estimate_type") == "primary")).orderBy(*order).limit(most)
    about = sources.select("source_id", F.col("title").alias("literature_title"), F.col("pub_year").alias("literature_year"))
    rows = numbered(kept.join(about, "source_id", "left"), [F.col(c) for c in order], "_n")
    return rows.withColumn("dp_id", F.concat(F.lit("dp_"), F.when(F.length(F.col("_n").cast("string")) < 4, F.lpad(F.col("_n").cast("string"), 4, "0")).otherwise(F.col("_n").cast("string")))).drop("_n")


def export_dataset(rows: DataFrame, path: str, filters: dict | None = None, licence: str = "Creative Commons Attribution 4.0 International") -> None:
    """An open dataset as a folder: ``data_points`` (CSV with a byte order mark before the header), ``data_dictionary``, ``README``, ``LICENSE``."""
    spark = rows.sparkSession
    names = [name for name, *_ in DICTIONARY if name in rows.columns]
    first = [F.col(names[0]).alias("\ufeff" + names[0]), *names[1:]]
    rows.select(*first).write.option("header", True).csv(f"{path}/data_points")
    known = [d for d in DICTIONARY if d[0] in names]
    spark.createDataFrame(known, "field_name string, data_type string, description string").coalesce(1).write.option("header", True).csv(f"{path}/data_dictionary")
    said = [f"{k}: {v}" for k, v in (filters or {}).items() if v not in (None, "")] or ["none: all approved facts"]
    text = [f"Facts: {rows.count()}", "Filters:", *said, "dp_id is a number of this dataset alone.", "Summaries should take primary estimates only."]
    for name, lines in (("README", text), ("LICENSE", [licence])):
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{path}/{name}")


class Snapshots:
    """Results kept with module, parameters and the hash of the facts they were made from."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, f"{root.rstrip('/')}/index")

    def _index(self) -> DataFrame | None:
        return self.store.read("snapshots") if self.store.version else None

    def keep(self, module: str, params: dict, digest: str, result: Callable[[], DataFrame]) -> str:
        """The token of the snapshot with the same module, parameters and hash; a new one writes ``result()`` first."""
        text = canonical_params(params)
        index = self._index()
        token = self.spark.range(1).select(F.sha2(F.lit(f"{module}|{text}|{digest}"), 256)).first()[0][:32]
        if index is not None and index.where(F.col("token") == token).count():
            return token
        result().write.mode("overwrite").parquet(f"{self.root}/results/{token}")
        row = self.spark.createDataFrame([(token, module, text, digest)], "token string, module string, params string, data_hash string").withColumn("created_at", F.current_timestamp())
        self.store.commit(snapshots=row if index is None else index.unionByName(row))
        return token

    def read(self, token: str) -> DataFrame | None:
        index = self._index()
        known = index is not None and index.where(F.col("token") == token).count() > 0
        return self.spark.read.parquet(f"{self.root}/results/{token}") if known else None


def with_snapshot(log: Snapshots, module: str, facts: Callable[..., DataFrame]):
    """Wrap an analysis ``f(**params)``: it returns its frame and the token of its snapshot; ``facts(**params)`` are those it reads."""
    def wrap(f: Callable[..., DataFrame]):
        @functools.wraps(f)
        def run(**params) -> tuple[DataFrame, str]:
            digest = data_hash(facts(**params)).first()["data_hash"]
            token = log.keep(module, params, digest, lambda: f(**params))
            return log.read(token), token

        return run

    return wrap
