"""Filtered scans, paging, listings and searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.functions.parsing import alias_by_longest


def provinces_match(wanted: str) -> Column:
    """One name matches as a part, several (comma-separated) as a whole."""
    names = [w.strip() for w in wanted.split(",") if w.strip()]
    return F.col("province").isin(names) if len(names) > 1 else F.col("province").ilike(f"%{names[0]}%")


def base_scan(
    obs: DataFrame,
    disease: str | None = None,
    province: str | None = None,
    years: tuple[int | None, int | None] = (None, None),
    ages: tuple[int | None, int | None] = (None, None),
    data_type: str | None = None,
    review_status: str | None = "approved",
    include_subgroups: bool = False,
    grades: tuple[str, ...] | None = ("A", "B"),
    population: str | None = None,
    aliases: dict[str, str] | None = None,
    gender: str | None = None,
) -> DataFrame:
    """The shared predicates; a bound of None or 0 is no filter, ages must lie within the bounds.

    With ``aliases`` the wanted disease and the rows' are compared by their standard names. ``gender`` is looked for in the
    description of the people.
    """
    tests = []
    if review_status:
        tests.append(F.col("review_status") == review_status)
    if not include_subgroups:
        tests.append(F.col("estimate_type") == "primary")
    if grades:
        tests.append(F.col("quality_grade").isin(*grades))
    if disease:
        same = (lambda name: alias_by_longest(name, aliases)) if aliases else (lambda name: name)
        tests.append(same(F.col("disease")) == same(F.lit(disease)))
    if province:
        tests.append(provinces_match(province))
    for bound, column, up in ((years[0], "collection_year", False), (years[1], "collection_year", True), (ages[0], "age_min", False), (ages[1], "age_max", True)):
        if bound:
            tests.append(F.col(column) <= bound if up else F.col(column) >= bound)
    if data_type:
        tests.append(F.col("data_type") == data_type)
    if population:
        tests.append(reduce(lambda a, b: a | b, [F.col("population").ilike(f"%{p.strip()}%") for p in population.split(",")]))
    if gender:
        tests.append(F.col("population").ilike(f"%{gender}%"))
    return obs.where(reduce(lambda a, b: a & b, tests)) if tests else obs


def split_provinces(obs: DataFrame) -> DataFrame:
    """A row per province of a multi-valued one; blank names are ``unknown``."""
    names = F.filter(F.transform(F.split("province", "[;；]"), lambda p: F.trim(p)), lambda p: p != "")
    return obs.withColumn("province", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("unknown")))))


def page(frame: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return frame.orderBy(*order).offset(offset).limit(limit)


def keyword(frame: DataFrame, word: str, columns: list[str]) -> DataFrame:
    return frame.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{word}%") for c in columns]))


def soft_delete(frame: DataFrame, condition: Column) -> DataFrame:
    return frame.withColumn("deleted", condition)
