"""Listings of sources: optional predicates, sort keys, pages with the total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.functions.parsing import file_format, review_state
from titerlake.sources.adapters import dealt

WITHOUT_FORMAT = "__NONE__"


def with_counters(sources: DataFrame, facts: DataFrame, tasks: int = 0) -> DataFrame:
    """``extracted`` and ``approved`` of each source: its facts, and those that are approved; counted in ``tasks`` tasks, if these are more than the session's."""
    counts = dealt(facts, tasks, "source_id").groupBy("source_id").agg(F.count("*").alias("extracted"), F.count_if(F.col("review_status") == "approved").alias("approved"))
    return sources.join(counts, "source_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("extracted", "approved")})


def list_sources(
    sources: DataFrame,
    keyword: str | None = None,
    title: str | None = None,
    authors: str | None = None,
    language: str | None = None,
    years: tuple[int | None, int | None] = (None, None),
    created: tuple[str | None, str | None] = (None, None),
    state: str | None = None,
    form: str | None = None,
    has_abstract: bool | None = None,
    tags: DataFrame | None = None,
    with_facts: DataFrame | None = None,
    deleted: bool = False,
) -> DataFrame:
    """The sources that meet every predicate given.

    ``created`` is a range of days, both inclusive. ``tags`` and ``with_facts`` keep sources whose id is among theirs.
    ``deleted`` lists the bin instead of the rest.
    """
    tests: list[Column] = [F.col("deleted_at").isNotNull() if deleted else F.col("deleted_at").isNull()]
    if keyword:
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{keyword}%"), F.lit(False)) for c in ("title", "authors", "abstract")]) | F.coalesce(F.array_join("keywords", " ").ilike(f"%{keyword}%"), F.lit(False)))
    for column, part in (("title", title), ("authors", authors)):
        if part:
            tests.append(F.col(column).ilike(f"%{part}%"))
    if language:
        tests.append(F.col("language") == language)
    if years[0]:
        tests.append(F.col("pub_year") >= years[0])
    if years[1]:
        tests.append(F.col("pub_year") <= years[1])
    if created[0]:
        tests.append(F.col("created_at") >= F.lit(created[0]).cast("date"))
    if created[1]:
        tests.append(F.col("created_at") < F.date_add(F.lit(created[1]).cast("date"), 1))
    if state:
        tests.append(review_state(F.col("extracted"), F.col("approved")) == state)
    if form:
        tests.append(F.col("file_path").isNull() if form == WITHOUT_FORMAT else file_format(F.col("file_path")) == form.upper())
    if has_abstract is not None:
        there = F.coalesce(F.col("abstract"), F.lit("")) != ""
        tests.append(there if has_abstract else ~there)
    out = sources.where(reduce(lambda a, b: a & b, tests))
    for among in (tags, with_facts):
        if among is not None:
            out = out.join(among.select("source_id").distinct(), "source_id", "left_semi")
    return out


def sort_key(name: str, descending: bool = False) -> Column:
    """A column, ``progress`` (approved of extracted) or ``format``; nulls last either way."""
    keys = {"progress": F.when(F.col("extracted") > 0, F.col("approved") / F.col("extracted")), "format": file_format(F.col("file_path"))}
    key = keys.get(name, F.col(name))
    return key.desc_nulls_last() if descending else key.asc_nulls_last()


def paged(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of the rows, each with the ``total`` of all; the total is one more aggregate of a row."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(total))


def titled(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with their source's title, null where it has none."""
    return facts.join(sources.select("source_id", "title"), "source_id", "left")


def empty_sources(sources: DataFrame) -> DataFrame:
    """Sources with neither a file nor an abstract."""
    return sources.where(F.col("file_path").isNull() & (F.coalesce("abstract", F.lit("")) == ""))


def expired(sources: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Sources that were deleted more than ``days`` days before ``now``."""
    return sources.where(F.col("deleted_at") < F.date_sub(F.lit(now).cast("date"), days))
