"""Logical evidence tables derived from the driver's star schema. Columns are pruned by each query that reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a fact table's files that one task takes after a shuffle.
TASK_BYTES = 8 << 20


def tasks_for(spark: SparkSession, sf_dir: str, name: str) -> int:
    """How many tasks a table is dealt out to, by the size of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() // TASK_BYTES + 1


def dealt(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``rows`` dealt out by ``keys`` to so many tasks, where these are more than the session's; what a task holds doesn't grow with the input."""
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per estimate: a positivity in percent or a geometric-mean concentration."""
    line, orders, customer, nation, region, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region", "part"))
    tasks = tasks_for(spark, sf_dir, "lineitem")
    # a join takes the number of tasks of the side that is dealt out; dealing the smaller side shuffles no fact rows where it is broadcast
    line, customer, part = dealt(line, tasks, "l_orderkey"), dealt(customer, tasks, "c_custkey"), dealt(part, tasks, "p_partkey")
    # nation and region are fixed dimensions of 25 and 5 rows; the optimizer chooses how to join the others
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    gmc, first = F.col("l_returnflag") == "R", F.substring("o_orderpriority", 1, 1)
    return rows.select(
        F.col("l_orderkey").alias("source_id"),
        F.col("p_type").alias("disease"),
        F.when(F.col("l_linenumber") == 7, F.concat("n_name", F.lit("; "), "r_name")).otherwise(F.col("n_name")).alias("province"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("city"),
        F.when(gmc, "gmc").otherwise("seroprevalence").alias("data_type"),
        F.when(gmc, F.col("l_extendedprice") / F.col("l_quantity")).otherwise(F.round(F.col("l_discount") * 1000)).alias("value"),
        F.col("l_quantity").cast("int").alias("sample_size"),
        (F.col("p_size") - 1).alias("age_min"),
        (F.col("p_size") + F.col("l_linenumber")).alias("age_max"),
        F.year("o_orderdate").alias("collection_year"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected").alias("review_status"),
        F.when(F.col("l_linestatus") == "O", "primary").otherwise("subgroup").alias("estimate_type"),
        F.col("p_brand").alias("assay"),
        F.when(F.col("l_linenumber") <= 2, "high").when(F.col("l_linenumber") <= 4, "medium").otherwise("low").alias("confidence"),
        F.when(first.isin("1", "2"), "A").when(first == "3", "B").otherwise("C").alias("quality_grade"),
        F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")).alias("review_seconds"),
        F.col("l_suppkey").alias("reviewer_id"),
        F.when(F.col("l_tax") < 0.03, "vaccinated").when(F.col("l_tax") < 0.06, "unvaccinated").otherwise("general").alias("population"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey") % 100000) * 10000 + F.col("l_suppkey") % 10000).alias("fact_id"),
    )


def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source document."""
    docs = table(spark, sf_dir, "documents")
    # the first eight words, with the blanks before, between and after them; the rest of a text isn't looked at
    opening = F.regexp_extract("text", r"^(?:\S*+\s++){0,7}+\S*+", 0)
    return docs.select(
        F.col("doc_id").alias("source_id"),
        F.regexp_replace(opening, r"\s+", " ").alias("title"),
        F.col("source").alias("authors"),
        F.col("lang").alias("language"),
        (F.lit(1990) + F.col("doc_id") % 30).alias("pub_year"),
        F.col("n_chars").alias("n_chars"),
        F.col("text").alias("text"),
    )


def catalogued_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with file, abstract, keywords, and the days they were created and deleted on."""
    i = F.col("source_id")
    ending = F.element_at(F.array(*map(F.lit, (".PDF", ".docx", ".html", ".htm", ".txt"))), (i % 5 + 1).cast("int"))
    return evidence_sources(spark, sf_dir).withColumns({
        "file_path": F.when(i % 7 == 0, None).when(i % 11 == 0, F.concat(F.lit("https://host/"), i)).otherwise(F.concat(F.lit("store/"), i, ending)),
        "abstract": F.when(i % 3 == 0, None).when(i % 3 == 1, "").otherwise(F.substr("text", F.lit(1), F.lit(80))),
        "keywords": F.array(F.col("language"), F.concat(F.lit("year "), F.col("pub_year"))),
        "created_at": F.date_add(F.lit("2020-01-01").cast("date"), (i % 400).cast("int")),
        "deleted_at": F.when(i % 13 == 0, F.date_add(F.lit("2021-06-01").cast("date"), (i % 60).cast("int"))),
    })
