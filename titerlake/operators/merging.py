"""Merging sources, importing records and replacing facts, as whole new tables of a versioned store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titerlake.functions.wording import normal_title
from titerlake.operators import linkage
from titerlake.sources.shared import Tables

#: How a field of the merged source comes about, and what becomes of facts that state the same (fixed values).
CHOICES = ("source", "target", "merge")
STRATEGIES = ("keep_both", "prefer_target", "prefer_source")
#: Columns in which two facts state the same thing; empty text and 0 count as null, and null equals null.
STATED = {"disease": "", "province": "", "collection_year": 0, "data_type": ""}
#: Fields that an import may complete in a known source.
COMPLETED = ("pub_year", "province", "journal", "authors", "abstract", "extraction_status")


class Store:
    """Tables in numbered versions below a shared folder.

    A commit writes the changed tables, then one row that names every table's folder; readers take the last row, so
    they see all tables of a commit or none. Unchanged tables stay where they are. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> tuple[int, dict[str, str]]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0, {}
        last = self.spark.read.schema("version long, tables map<string,string>").json(f"{self.root}/log").orderBy(F.desc("version")).first()
        return (last["version"], last["tables"]) if last else (0, {})

    @property
    def version(self) -> int:
        return self._log()[0]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._log()[1][name])

    def commit(self, **tables: DataFrame) -> int:
        version, paths = self._log()
        version += 1
        for name, frame in tables.items():
            paths[name] = f"{self.root}/{name}/version={version}"
            frame.write.parquet(paths[name])
        row = self.spark.createDataFrame([(version, paths)], "version long, tables map<string,string>")
        row.coalesce(1).write.mode("append").json(f"{self.root}/log")
        return version


def _key(prefix: str = "") -> list[Column]:
    return [F.nullif(F.col(c), F.lit(empty)).alias(prefix + c) for c, empty in STATED.items()]


def valid_merges(sources: DataFrame, merges: DataFrame) -> DataFrame:
    """The ``source_id, target_id`` of ``merges`` that can be done: both known and different, a source once (its least target), and
    no target that is itself merged away.
    """
    known = sources.select("source_id")
    rows = merges.where(F.col("source_id") != F.col("target_id")).join(known, "source_id", "left_semi")
    rows = rows.join(known.withColumnRenamed("source_id", "target_id"), "target_id", "left_semi").groupBy("source_id").agg(F.min("target_id").alias("target_id"))
    return rows.join(rows.select(F.col("source_id").alias("target_id")), "target_id", "left_anti").select("source_id", "target_id")


def merge_facts(facts: DataFrame, merges: DataFrame, strategy: str = "keep_both") -> DataFrame:
    """All facts with what becomes of each: ``action`` is ``stay``, ``move`` (to ``owner``, the merge's target) or ``drop``.

    Facts of a source that state the same as one of its target conflict: ``keep_both`` moves them too, ``prefer_target`` drops
    them, ``prefer_source`` drops the target's. Whether a side has a statement is looked up by its key, so
    conflicting facts are never paired.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    into = merges.select("source_id", F.col("target_id").alias("_into"))
    targets = merges.select(F.col("target_id").alias("source_id")).distinct().withColumn("_is_target", F.lit(True))
    rows = facts.join(into, "source_id", "left").join(targets, "source_id", "left")
    rows = rows.withColumn("_owner", F.coalesce("_into", "source_id")).withColumns({f"_{c}": F.nullif(F.col(c), F.lit(empty)) for c, empty in STATED.items()})
    keys = ["_owner", *[f"_{c}" for c in STATED]]
    moving = F.col("_into").isNotNull()
    held = rows.where(moving | F.col("_is_target")).groupBy(*keys).agg(F.bool_or(moving).alias("_from_source"), F.bool_or(~moving).alias("_from_target"))
    same = reduce(lambda a, k: a & rows[k].eqNullSafe(held[k]), keys[1:], rows["_owner"] == held["_owner"])
    joined = rows.join(held.where("_from_source AND _from_target"), same, "left").select(*[rows[c] for c in facts.columns], rows["_into"], "_from_source")
    conflict = F.coalesce("_from_source", F.lit(False))
    drop = {"keep_both": F.lit(False), "prefer_target": conflict & F.col("_into").isNotNull(), "prefer_source": conflict & F.col("_into").isNull()}[strategy]
    action = F.when(drop, "drop").when(F.col("_into").isNotNull(), "move").otherwise("stay")
    return joined.select(*facts.columns, F.coalesce("_into", "source_id").alias("owner"), action.alias("action"))


def merge_sources(sources: DataFrame, facts: DataFrame, merges: DataFrame, choices: dict[str, str], strategy: str = "keep_both") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new sources, the new facts, and a report by target: ``moved``, ``dropped``, ``extracted_count``, ``approved_count``.

    Fields named in ``choices`` take the ``source``'s value or, arrays, the target's values and then the source's new ones
    (``merge``); others stay. Of several sources of a target the one of the least id gives its values, arrays take
    all in the order of ids. Merged sources go; the target's counts are counted anew.
    """
    bad = {f: c for f, c in choices.items() if c not in CHOICES or f not in sources.columns}
    if bad:
        raise ValueError(f"no such field or choice: {bad}")
    merges = valid_merges(sources, merges)
    dealt = merge_facts(facts, merges, strategy)
    new_facts = dealt.where("action <> 'drop'").withColumn("source_id", F.col("owner")).select(*facts.columns)
    approved = F.col("review_status") == "approved"
    targets = merges.select(F.col("target_id").alias("owner")).distinct()
    report = dealt.join(targets, "owner", "left_semi").groupBy("owner").agg(
        F.count_if(F.col("action") == "move").alias("moved"), F.count_if(F.col("action") == "drop").alias("dropped"),
        F.count_if(F.col("action") != "drop").alias("extracted_count"), F.count_if((F.col("action") != "drop") & approved).alias("approved_count"),
    )
    report = targets.join(report, "owner", "left").select(F.col("owner").alias("target_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("moved", "dropped", "extracted_count", "approved_count")])

    wanted = [f for f, c in choices.items() if c != "target"]
    given = merges.join(sources.select("source_id", *wanted), "source_id").groupBy("target_id").agg(
        F.array_sort(F.collect_list(F.struct("source_id", *wanted))).alias("_given")  # the sources of one target: a few copies of a paper
    )
    rest = sources.join(merges.select("source_id"), "source_id", "left_anti")
    rows = rest.join(given.withColumnRenamed("target_id", "source_id"), "source_id", "left").join(report.withColumnRenamed("target_id", "source_id"), "source_id", "left")
    arrays = {f.name for f in sources.schema.fields if f.dataType.typeName() == "array"}
    changed = {}
    for f in wanted:
        empty = F.array().cast(sources.schema[f].dataType) if f in arrays else None
        if choices[f] == "merge" and f in arrays:
            all_values = F.flatten(F.transform("_given", _values_of(f, empty)))
            changed[f] = F.when(F.col("_given").isNotNull(), F.array_distinct(F.concat(F.coalesce(F.col(f), empty), all_values))).otherwise(F.col(f))
        elif choices[f] == "source":
            changed[f] = F.when(F.col("_given").isNotNull(), F.get("_given", 0)[f]).otherwise(F.col(f))
    for c in ("extracted_count", "approved_count"):
        if c in sources.columns:
            changed[c] = F.coalesce(report[c], rest[c])
    new_sources = rows.select(*[changed[c].alias(c) if c in changed else rest[c] for c in sources.columns])
    return new_sources, new_facts, report


def _values_of(field: str, empty: Column):
    return lambda given: F.coalesce(given[field], empty)


def compared_fields(sources: DataFrame, merges: DataFrame, fields: list[str]) -> DataFrame:
    """``source_id, target_id, field, source_value, target_value, differs`` of every merge and field, values as text."""
    def side(key: str, name: str) -> DataFrame:
        values = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).cast("string") for f in fields]))
        return sources.select(F.col("source_id").alias(key), values.alias(name))

    rows = merges.join(side("source_id", "s"), "source_id").join(side("target_id", "t"), "target_id").withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    s, t = F.element_at("s", F.col("field")), F.element_at("t", F.col("field"))
    return rows.select("source_id", "target_id", "field", s.alias("source_value"), t.alias("target_value"), (~s.eqNullSafe(t)).alias("differs"))


def replace_facts(facts: DataFrame, extracted: DataFrame, keep_approved: bool = False) -> DataFrame:
    """Facts once ``extracted`` ones are written: those of its sources make room, approved ones stay if ``keep_approved``."""
    renewed = extracted.select("source_id").distinct().withColumn("_new", F.lit(True))
    gone = F.col("_new").isNotNull()
    if keep_approved:
        gone = gone & (F.coalesce("review_status", F.lit("")) != "approved")
    return facts.join(renewed, "source_id", "left").where(~gone).select(*facts.columns).unionByName(extracted.select(*facts.columns))


_IMPORT = (
    "literatures array<struct<title: string, title_en: string, authors: string, journal: string, pub_year: int, doi: string, pmid: string, abstract: string, keywords: array<string>, province: string, source_db: string, "
    "extraction_status: string, data_points: array<struct<disease: string, province: string, city: string, collection_year: int, age_min: int, age_max: int, sample_size: int, data_type: string, value: double, "
    "estimate_type: string, confidence: string, review_status: string>>>>"
)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON exports, one row each: ``position`` (file, then place in it), the fields, and the facts as an array."""
    files = spark.read.schema(_IMPORT).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "literatures")
    rows = files.select("file", F.posexplode("literatures").alias("at", "e"))
    return rows.select(F.struct("file", "at").alias("position"), "e.*")


def plan_import(known: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries with a title, with ``match`` (the id of the known source of the same DOI, else the same title) and ``leader``, the
    position of the entry that brings the same new source; its own if it is the one.

    As if taken in one by one: an entry brings a source if no earlier one that does has its DOI or title. Each round settles
    the entries that are first by both, and those that follow them; entries wait for a further round only where the
    first one of their DOI or title turned out to bring nothing. Blank DOIs match nothing.
    """
    tables = Tables(entries.sparkSession, "import")
    rows = entries.withColumns({"title": F.trim("title"), "doi": F.nullif(F.trim("doi"), F.lit(""))}).where(F.length("title") > 0)
    by_doi = known.where(F.length("doi") > 0).groupBy("doi").agg(F.min("source_id").alias("_by_doi"))
    by_title = known.where(F.length("title") > 0).groupBy("title").agg(F.min("source_id").alias("_by_title"))
    rows = rows.join(by_doi, "doi", "left").join(by_title, "title", "left").withColumn("match", F.coalesce("_by_doi", "_by_title")).drop("_by_doi", "_by_title")
    rows = tables.write(rows)
    waiting, settled = rows.where("match IS NULL").select("position", "doi", "title"), []
    while True:
        first_doi = waiting.where("doi IS NOT NULL").groupBy("doi").agg(F.min("position").alias("_doi"))
        first_title = waiting.groupBy("title").agg(F.min("position").alias("_title"))
        each = waiting.join(first_doi, "doi", "left").join(first_title, "title")
        brings = (F.coalesce("_doi", "position") == F.col("position")) & (F.col("_title") == F.col("position"))
        made = tables.write(each.where(brings).select("position", "doi", "title"))
        of_doi = made.where("doi IS NOT NULL").select("doi", F.col("position").alias("_doi"))
        of_title = made.select("title", F.col("position").alias("_title"))
        led = waiting.join(of_doi, "doi", "left").join(of_title, "title", "left").withColumn("leader", F.coalesce("_doi", "_title"))
        led = tables.write(led.select("position", "doi", "title", "leader"))
        settled.append(led.where("leader IS NOT NULL").select("position", "leader"))
        waiting = led.where("leader IS NULL").select("position", "doi", "title")
        if waiting.isEmpty():
            return rows.join(reduce(DataFrame.unionByName, settled), "position", "left")


def import_export(sources: DataFrame, facts: DataFrame, entries: DataFrame, skip_duplicates: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources and facts with the entries of ``read_export`` taken in, and one row of counts: ``imported, updated, skipped, without_title, facts_added``.

    A new source gets the hash of its DOI or title as its id. Entries of known sources, or of one that an earlier entry
    brought, are skipped, or (not ``skip_duplicates``) complete its fields: the last entry's values that say something win. A
    fact that its source has already is not added again, so a second import changes nothing.
    """
    planned = plan_import(sources, entries)
    first = planned.where(F.col("match").isNull() & (F.col("position") == F.col("leader")))
    made = F.xxhash64(F.coalesce("doi", "title"))
    ids = first.select(F.col("position").alias("leader"), made.alias("_made"))
    rows = planned.join(ids, "leader", "left").withColumn("_id", F.coalesce("match", "_made")).withColumn("_first", F.col("match").isNull() & (F.col("position") == F.col("leader")))
    used = rows if not skip_duplicates else rows.where("_first")
    defaults = {"source_db": "import", "extraction_status": "done"}
    new = rows.where("_first").select(
        *[F.col("_id").alias(c) if c == "source_id" else (F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(defaults[c])) if c in defaults else F.col(c) if c in planned.columns else F.lit(None)).cast(sources.schema[c].dataType).alias(c) for c in sources.columns]
    )
    out = sources.unionByName(new)
    fields = [c for c in COMPLETED if c in sources.columns and c in planned.columns]
    if not skip_duplicates and fields:
        def says(c: str) -> Column:
            return (F.col(c).isNotNull()) & (F.col(c) != (F.lit(0) if sources.schema[c].dataType.typeName() in ("integer", "long") else F.lit("")))

        last = rows.where(~F.col("_first")).groupBy(F.col("_id").alias("source_id")).agg(*[F.max_by(F.when(says(c), F.col(c)), F.when(says(c), F.col("position"))).alias(f"_{c}") for c in fields])
        out = out.join(last, "source_id", "left").select(*[F.coalesce(f"_{c}", c).cast(sources.schema[c].dataType).alias(c) if c in fields else F.col(c) for c in sources.columns])
    found = used.select(F.col("_id").alias("source_id"), F.explode("data_points").alias("f")).select("source_id", "f.*")
    usual = {"estimate_type": "primary", "confidence": "medium", "review_status": "pending"}
    found = found.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in usual.items()}).distinct()
    shared = [c for c in facts.columns if c in found.columns]
    # null equals null: as structs the rows compare whole
    mark = F.xxhash64(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in shared]), {"ignoreNullFields": "false"}))
    fresh = found.withColumn("_mark", mark).join(facts.select("source_id", mark.alias("_mark")), ["source_id", "_mark"], "left_anti")
    added = fresh.select(*[F.col(c).cast(facts.schema[c].dataType).alias(c) if c in shared else (F.abs("_mark") if c == "fact_id" else F.lit(None)).cast(facts.schema[c].dataType).alias(c) for c in facts.columns])
    untitled = entries.where(F.coalesce(F.length(F.trim("title")), F.lit(0)) == 0).agg(F.count("*").alias("without_title"))
    other = F.count_if(~F.col("_first"))
    counts = rows.agg(F.count_if("_first").alias("imported"), (F.lit(0) if skip_duplicates else other).cast("long").alias("updated"), (other if skip_duplicates else F.lit(0)).cast("long").alias("skipped"))
    counts = counts.join(untitled).join(added.agg(F.count("*").alias("facts_added")))  # one row each
    return out, facts.unionByName(added), counts


def import_preview(known: DataFrame, found: DataFrame) -> DataFrame:
    """One row: ``total``, ``skipped`` (no title, or a known PMID, DOI or normal title) and ``imported`` records of a bibliography; nothing is written."""
    rows = found.select(F.monotonically_increasing_id().alias("_n"), F.trim("title").alias("title"), F.nullif(F.trim("pmid"), F.lit("")).alias("pmid"), F.nullif(F.trim("doi"), F.lit("")).alias("doi"))
    rows = rows.withColumn("normal", normal_title(F.col("title")))
    for key in ("pmid", "doi", "normal"):
        column = normal_title(F.col("title")) if key == "normal" else F.col(key)
        seen = known.select(column.alias(key)).where(F.length(key) > 0).distinct().withColumn(f"_{key}", F.lit(True))
        rows = rows.join(seen, key, "left")
    skipped = (F.coalesce(F.length("title"), F.lit(0)) == 0) | F.col("_pmid").isNotNull() | F.col("_doi").isNotNull() | F.col("_normal").isNotNull()
    return rows.agg(F.count("*").alias("total"), F.count_if(skipped).alias("skipped"), F.count_if(~skipped).alias("imported"))


def best_title_match(titles: DataFrame, sources: DataFrame, least: float = 0.7) -> DataFrame:
    """``name, source_id, similarity``: of the sources whose title tokens are alike by ``least`` or more, the most alike one, and of equals the first.

    Equal titles are one row on either side. No source is more alike than one with the same tokens, and next comes one with
    a single token more, so titles that find such a source are settled by keys (``linkage.nearest_holders``). The others meet
    sources by the signatures of their rarest-first order, as in ``title_pairs``, never all with all.
    """
    tables = Tables(sources.sparkSession, "titles")

    def tokens(frame: DataFrame, key: str) -> DataFrame:
        t = F.sort_array(F.array_distinct(F.array_remove(F.split(normal_title(F.col("title")), " "), "")))
        return tables.write(frame.select(F.col(key).alias(key), t.alias("tokens"))).where(F.size("tokens") > 0)

    names = tokens(titles, "name")
    wanted = tables.write(names.select("tokens").distinct())
    classes = tables.write(tokens(sources, "source_id").groupBy("tokens").agg(F.min("source_id").alias("source_id")))  # of equal titles only the first can win
    near = tables.write(linkage.nearest_holders(wanted, classes))
    rest = tables.write(wanted.join(near, "tokens", "left_anti"))
    tables.drop(wanted)
    # the order is common to all if tokens that no title of the rest has come first
    asked = rest.select(F.explode("tokens").alias("token")).distinct()
    counted = classes.select(F.explode("tokens").alias("token")).join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    counted = tables.write(counted)  # so that Spark knows its size

    def signed(sets: DataFrame, name: str) -> DataFrame:
        ordered = linkage.rarest_first(sets, counted, least)
        return ordered.withColumnRenamed("tokens", name).withColumn("signature", F.explode(linkage.signatures(F.col("ordered"), least))).drop("ordered")

    found = signed(rest, "tokens").join(signed(classes, "held"), "signature").withColumn("s", linkage.likeness("tokens", "held")).where(F.col("s") >= least)

    def first(rows: DataFrame, key: str) -> DataFrame:
        order = F.struct((-F.col("s")).alias("m"), F.col("source_id").isNull().alias("unknown"), "source_id")
        return rows.groupBy(key).agg(F.min(order).alias("b")).select(key, "b.source_id", (-F.col("b.m")).alias("s"))

    best = near.where(F.col("s") >= least).unionByName(first(found, "tokens"))
    return first(names.join(best, "tokens"), "name").select("name", "source_id", F.round("s", 4).alias("similarity"))
