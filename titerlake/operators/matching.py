"""Joins on containment, and look-ups that fall back from rank to rank, as equi joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.sources.adapters import dealt


def _grams(text: str, n: int) -> Column:
    """Distinct runs of ``n`` characters; none of a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, holders: DataFrame, width: int = 4) -> DataFrame:
    """All pairs of a distinct ``needle`` and a distinct ``holder`` whose text contains it; case counts.

    A needle is looked up by the rarest of its runs of ``width`` characters (a shorter needle by itself), so a common run
    such as a file ending never brings all texts together, and no pair is formed without a common run. Empty and null
    texts pair with nothing.
    """
    wanted = needles.select("needle").where(F.length("needle") > 0).distinct()
    texts = holders.select("holder").where(F.length("holder") > 0).distinct()
    n = F.least(F.length("needle"), F.lit(width))
    lengths = sorted(r["n"] for r in wanted.select(n.alias("n")).distinct().collect())  # at most ``width`` numbers
    own = reduce(lambda a, k: a.when(n == k, _grams("needle", k)), lengths, F.when(F.lit(False), F.array().cast("array<string>")))
    each = wanted.select("needle", F.explode(own).alias("gram"))
    runs = F.flatten(F.array(F.array().cast("array<string>"), *[_grams("holder", k) for k in lengths]))
    there = texts.select("holder", F.explode(runs).alias("gram"))
    spread = there.join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a needle with a run that no text has is in none of them
    rarest = each.join(spread, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0")
    pairs = rarest.select("needle", F.col("least.gram").alias("gram")).join(there, "gram")
    return pairs.where(F.contains("holder", "needle")).select("needle", "holder")


def either_containing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ``left`` and ``right`` texts of which one contains the other."""
    a = containing(left.select(F.col("left").alias("needle")), right.select(F.col("right").alias("holder"))).select(F.col("needle").alias("left"), F.col("holder").alias("right"))
    b = containing(right.select(F.col("right").alias("needle")), left.select(F.col("left").alias("holder"))).select(F.col("holder").alias("left"), F.col("needle").alias("right"))
    return a.unionByName(b).distinct()


def ranked_lookup(rows: DataFrame, ranks: list[tuple[str, DataFrame, list[str]]], values: list[str], order: str | None = None) -> DataFrame:
    """``rows`` with ``values`` from the first rank that has them, and its name as ``rank``; null where none has.

    A rank is ``(name, table, keys)``: an equi join on columns that both sides have. Of table rows with equal keys the one
    with the least ``order`` (or the least values) counts, so no row is doubled. A null key matches nothing.
    """
    out, found = rows, []
    for i, (_, side, keys) in enumerate(ranks):
        column = f"_rank{i}"
        picked = F.struct(*([F.col(order).alias("_o")] if order else []), *values)
        best = side.dropna(subset=keys).groupBy(*keys).agg(F.min(picked).alias(column))
        out = out.join(best, keys, "left")
        found.append(column)
    name = reduce(lambda a, i: a.when(F.col(found[i]).isNotNull(), ranks[i][0]), range(1, len(ranks)), F.when(F.col(found[0]).isNotNull(), ranks[0][0]))
    taken = {v: F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c)[v].alias("v"))) for c in found])["v"] for v in values}
    return out.select(*rows.columns, *[c.alias(v) for v, c in taken.items()], name.alias("rank"))


def city_places(facts: DataFrame, cities: DataFrame, centres: DataFrame) -> DataFrame:
    """``facts`` with ``latitude``, ``longitude``: the city's, else those of the first city of the province (by ``position``) whose
    name holds the fact's or is held by it, else the province's centre.

    Distinct names are matched, and only within a province, so the facts themselves join twice by name. A province of
    which no city is known gives no place.
    """
    names = facts.select("province", "city").where(F.col("province").isNotNull()).distinct()
    near = names.join(cities.withColumnRenamed("city", "known"), "province").where(F.contains("city", "known") | F.contains("known", "city"))
    centre = centres.join(cities.select("province").distinct(), "province", "left_semi").withColumn("position", F.lit(0))
    values = ["latitude", "longitude"]
    exact = ("exact", cities.select("province", "city", "position", *values), ["province", "city"])
    part = ("part", near.select("province", "city", "position", *values), ["province", "city"])
    return ranked_lookup(facts, [exact, part, ("centre", centre.select("province", "position", *values), ["province"])], values, "position")


def link_to_parents(facts: DataFrame, tasks: int = 0) -> DataFrame:
    """``fact_id, parent_id, rank`` for every subgroup fact: the first primary one of its source, disease and type whose province
    or city its ``parent_group`` names; for an empty group the first of them all; else null. Joins and groups take ``tasks``
    tasks, if these are more than the session's.
    """
    keys = ["source_id", "disease", "data_type"]
    sub = facts.where(F.col("estimate_type") == "subgroup").select("fact_id", *keys, F.coalesce("parent_group", F.lit("")).alias("parent_group"))
    primary = facts.where(F.col("estimate_type") == "primary").select(*keys, F.col("fact_id").alias("parent_id"), "province", "city")
    sub, primary = dealt(sub, tasks, *keys, "parent_group"), dealt(primary, tasks, *keys)

    def names(part: str) -> Column:
        return (F.length(part) > 0) & F.contains("parent_group", part)

    named = sub.select(*keys, "parent_group").distinct().join(primary, keys).where(names("province") | names("city"))
    named = ("named", named.select(*keys, "parent_group", "parent_id"), [*keys, "parent_group"])
    whole = ("first", primary.select(*keys, "parent_id").withColumn("parent_group", F.lit("")), [*keys, "parent_group"])
    return ranked_lookup(sub, [named, whole], ["parent_id"]).select("fact_id", "parent_id", "rank")


def orphan_files(files: DataFrame, sources: DataFrame, id_name: str = r"^([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\.txt$") -> DataFrame:
    """``name, reason`` of every stored file: ``id`` (an extract of a known source), ``name`` or ``part`` (a path of a source has
    it as its last step, or anywhere), or null for an orphan.

    A file whose name has the form of an extract counts by its id alone.
    """
    names = files.select("name").where(F.col("name").isNotNull()).distinct()
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    paths = sources.where(F.length("file_path") > 0).select(F.col("file_path").alias("path"), F.element_at(F.split(path, "/"), -1).alias("last"))
    extract = F.regexp_extract("name", id_name, 1)
    marked = names.select("name", F.nullif(extract, F.lit("")).alias("owner"))
    owned = sources.select(F.col("source_id").cast("string").alias("owner"), F.lit(True).alias("owned")).distinct()
    whole = paths.select(F.explode(F.array("last", "path")).alias("name")).distinct().withColumn("whole", F.lit(True))
    parts = containing(names.select(F.col("name").alias("needle")), paths.select(F.explode(F.array("last", "path")).alias("holder")))
    parts = parts.select(F.col("needle").alias("name")).distinct().withColumn("part", F.lit(True))
    rows = marked.join(owned, "owner", "left").join(whole, "name", "left").join(parts, "name", "left")
    reason = F.when(F.col("owner").isNotNull(), F.when(F.col("owned"), "id")).when(F.col("whole"), "name").when(F.col("part"), "part")
    return rows.select("name", reason.alias("reason"))
