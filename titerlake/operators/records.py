"""Extracted records, maps of text by field name, as facts of standard names and types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.functions import names, parsing

#: Other names of a field, in the order in which they are tried (fixed values).
ALIASES = {
    "positivity_rate": ("seroprevalence", "positive_rate", "positivity", "seropositivity", "seroprevalence_rate"),
    "gmc_value": ("gmc", "geometric_mean_concentration", "geometric_mean_titer", "gmt", "gmt_value"),
    "disease_name": ("virus_strain", "virus", "pathogen", "antigen"),
    "confidence_interval": ("ci", "positivity_ci"),
}
#: Fields that give titers instead of concentrations, parts of field names that hold a rate, and diseases that such a name may tell, in order (fixed values).
TITERS = ("geometric_mean_titer", "gmt", "gmt_value")
RATES = ("positivity_rate", "positivity", "seroprevalence", "seropositivity")
DISEASES_IN_KEYS = (
    ("measles", "measles"), ("rubella", "rubella"), ("mumps", "mumps"), ("influenza", "influenza"), ("flu", "influenza"), ("covid", "covid-19"), ("sars_cov_2", "covid-19"), ("sars-cov-2", "covid-19"),
    ("hbv", "hepatitis b"), ("hcv", "hepatitis c"), ("hav", "hepatitis a"), ("hev", "hepatitis e"), ("hpv", "hpv"), ("hiv", "hiv"), ("tb", "tuberculosis"), ("diphtheria", "diphtheria"), ("tetanus", "tetanus"),
    ("pertussis", "pertussis"), ("polio", "polio"), ("japanese_encephalitis", "japanese encephalitis"), ("je", "japanese encephalitis"), ("rabies", "rabies"), ("varicella", "varicella"), ("zoster", "zoster"),
    ("dengue", "dengue"), ("zika", "zika"), ("yellow_fever", "yellow fever"),
)
#: Names of assays in titer tables (fixed values).
ASSAYS = {"hi": "hi", "hai": "hi", "vnt": "vnt", "nt": "vnt", "elisa": "elisa"}
_TEXTS = ("city", "population_type", "gmc_unit", "journal", "authors", "source_context", "parent_group")
_WHOLE = ("study_start_year", "study_end_year", "sample_year", "age_min", "age_max", "sample_size", "source_page")
_NUMBERS = ("positivity_rate", "positivity_ci_lower", "positivity_ci_upper", "gmc_value", "gmc_ci_lower", "gmc_ci_upper")


def disease_in_key(key: Column) -> Column:
    """The disease that a composite field name tells, the first of the list that it holds."""
    low = F.lower(key)
    (part, name), *rest = DISEASES_IN_KEYS
    return reduce(lambda a, p: a.when(F.contains(low, F.lit(p[0])), p[1]), rest, F.when(F.contains(low, F.lit(part)), name))


def _field(record: Column, name: str) -> Column:
    return F.try_element_at(record, F.lit(name))


def _first(record: Column, name: str, blank_counts: bool = True) -> Column:
    """A field under its name or the first other name that says something."""
    values = [_field(record, n) for n in (name, *ALIASES[name])]
    return F.coalesce(*(values if blank_counts else [F.nullif(v, F.lit("")) for v in values]))


def standard_records(records: DataFrame, diseases: dict[str, str] | None = None) -> DataFrame:
    """``records`` (whatever their other columns) with the fields of the map column ``record`` in their standard form.

    Other names of a field are folded into it; a rate may also stand under a name such as ``after_rate_measles``, whose
    first number (by name) counts if there is no other, and which tells the disease. Numbers are read tolerantly,
    bounds may come as the text of an interval; what is no number is null. An unknown estimate type is ``primary``.
    """
    r = F.col("record")
    rates = lambda e: reduce(lambda a, b: a | b, [F.contains(F.lower(e["key"]), F.lit(p)) for p in RATES]) & parsing.tolerant_float(e["value"]).isNotNull()
    # what many fields come from is a column of its own: computed once a row, in steps short enough to be compiled
    steps = records.withColumn("_simple", _first(r, "positivity_rate")).withColumn("_composite", F.when(F.col("_simple").isNull(), F.array_min(F.filter(F.map_entries(r), rates))))
    simple, composite = F.col("_simple"), F.col("_composite")
    titer = F.when(_field(r, "gmc_value").isNull() & _field(r, "gmc").isNull() & _field(r, "geometric_mean_concentration").isNull() & F.coalesce(*[_field(r, t) for t in TITERS]).isNotNull(), "titer")
    low, high = parsing.interval(_first(r, "confidence_interval", False))
    steps = steps.withColumns({
        "_rate": parsing.tolerant_float(F.coalesce(simple, composite["value"])), "_disease": F.coalesce(_first(r, "disease_name", False), disease_in_key(composite["key"])), "_gmc": parsing.tolerant_float(_first(r, "gmc_value")),
        "_lower": _field(r, "positivity_ci_lower"), "_upper": _field(r, "positivity_ci_upper"), "_low": low, "_high": high, "_unit": F.coalesce(_field(r, "gmc_unit"), titer),
    })
    disease, none = F.col("_disease"), F.col("_lower").isNull() & F.col("_upper").isNull()
    low, high = (F.when(none, F.col(said)).otherwise(parsing.tolerant_float(F.col(bound))) for said, bound in (("_low", "_lower"), ("_high", "_upper")))
    kind = _field(r, "estimate_type")
    columns = {
        "disease_name": names.standard_disease(disease, diseases) if diseases else F.when(F.length(disease) > 0, F.trim(disease)),
        "detection_method": names.standard_method(_field(r, "detection_method")), "antibody_type": names.standard_antibody(_field(r, "antibody_type")), "province": names.standard_province(_field(r, "province")),
        **{t: _field(r, t) for t in _TEXTS}, "estimate_type": F.when(kind.isin("primary", "subgroup"), kind).otherwise("primary"),
        **{w: F.regexp_extract(_field(r, w), r"^\s*([+-]?\d+)\s*$", 1).try_cast("int") for w in _WHOLE},
        **{n: parsing.tolerant_float(_field(r, n)) for n in _NUMBERS},
        "positivity_rate": F.col("_rate"), "positivity_ci_lower": low, "positivity_ci_upper": high, "gmc_value": F.col("_gmc"), "gmc_unit": F.col("_unit"),
    }
    return steps.select(*[c for c in records.columns if c != "record" and c not in columns], *[c.alias(k) for k, c in columns.items()])


def facts_of(records: DataFrame) -> DataFrame:
    """A row for each value of a standard record: its rate in percent, its concentration, both, or none."""
    value = lambda kind, v, unit, low, high: F.when(F.col(v).isNotNull(), F.struct(F.lit(kind).alias("data_type"), F.col(v).alias("value"), unit.alias("unit"), F.col(low).alias("ci_lower"), F.col(high).alias("ci_upper")))
    both = F.array(
        value("seroprevalence", "positivity_rate", F.lit("%"), "positivity_ci_lower", "positivity_ci_upper"), value("gmc", "gmc_value", F.col("gmc_unit"), "gmc_ci_lower", "gmc_ci_upper")
    )
    rest = [c for c in records.columns if c not in (*_NUMBERS, "gmc_unit", "sample_year", "study_start_year", "study_end_year")]
    year = F.coalesce(F.nullif("sample_year", F.lit(0)), "study_start_year").alias("collection_year")
    rows = records.select(*rest, year, F.explode(F.filter(both, lambda f: f.isNotNull())).alias("f"))
    return rows.select(*rest, "collection_year", "f.*")


def titer_tables(tables: DataFrame) -> DataFrame:
    """The cells of the titer tables that are sound: ``antigens`` and ``ref_antisera`` name their rows and columns, ``titers`` has a
    text for each cell, and the assay is known. A table that isn't is left out whole. ``table_id, assay, antigen, serum, titer``.
    """
    assay = F.try_element_at(F.create_map(*[F.lit(x) for pair in ASSAYS.items() for x in pair]), F.lower(F.trim("assay_type")))
    rows, columns = F.size("antigens"), F.size("ref_antisera")
    sound = (rows > 0) & (columns > 0) & (F.size("titers") == rows) & F.forall("titers", lambda t: F.coalesce(F.size(t) == columns, F.lit(False))) & assay.isNotNull()
    each = tables.where(sound).select("table_id", assay.alias("assay"), "antigens", "ref_antisera", F.posexplode("titers").alias("i", "row"))
    each = each.select("table_id", "assay", F.get("antigens", F.col("i")).alias("antigen"), "ref_antisera", F.posexplode("row").alias("j", "cell"))
    return each.select("table_id", "assay", "antigen", F.get("ref_antisera", F.col("j")).alias("serum"), parsing.titer_cell(F.col("cell")).alias("titer"))
