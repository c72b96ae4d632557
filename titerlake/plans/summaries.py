"""Queries of analysis cells, gaps of evidence and standard names, and the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from titerlake.functions import names, stats
from titerlake.operators import cells, gaps, scan, summary
from titerlake.plans import sql
from titerlake.plans.registry import query
from titerlake.sources.adapters import observations, table

#: Standard population of the year 2020: share of each age band, and its first and last age (fixed values).
STANDARD_2020 = (
    ("0", 0.01337, 0, 0), ("1-4", 0.05326, 1, 4), ("5-14", 0.11513, 5, 14), ("15-24", 0.11695, 15, 24), ("25-34", 0.15482, 25, 34), ("35-44", 0.14317, 35, 44),
    ("45-54", 0.15937, 45, 54), ("55-64", 0.10804, 55, 64), ("65-74", 0.08860, 65, 74), ("75-84", 0.03868, 75, 84), ("85+", 0.00861, 85, 120),
)


def _scan(spark, sf):
    return scan.split_provinces(scan.base_scan(observations(spark, sf)))


def _band(mid):
    """The band of the standard population that a midpoint lies in."""
    out = F.when(mid < STANDARD_2020[1][2], STANDARD_2020[0][0])
    for (band, *_), after in zip(STANDARD_2020[1:], STANDARD_2020[2:], strict=False):
        out = out.when(mid < after[2], band)
    return out.otherwise(STANDARD_2020[-1][0])


_BAND_SQL = "CASE " + " ".join(f"WHEN {sql.MID} < {after[2]} THEN '{band}'" for (band, *_), after in zip(STANDARD_2020, STANDARD_2020[1:], strict=False)) + f" ELSE '{STANDARD_2020[-1][0]}' END"


def _cells_sql(key: str, expression: str | None = None) -> str:
    """Meta-merged cells: the meta-analysis, the weighted mean, and the concentration, joined by key."""
    made = f"{expression} AS {key}" if expression else key
    merged = sql.double_arcsine(key)
    if expression:  # the key is made from each row before the meta-analysis groups by it
        merged = merged.replace(sql.SERO, f"{sql.SERO}, sero_ AS (SELECT *, {made} FROM sero)", 1).replace("FROM sero WHERE", "FROM sero_ WHERE", 1)
    return f"""WITH meta_ AS ({merged}),
rates AS ({sql.SERO} SELECT {made}, {sql.RATE} FROM sero GROUP BY ALL),
gmcs AS ({sql.EACH} SELECT {made}, {sql.GMC} FROM each_ WHERE data_type = 'gmc' GROUP BY ALL),
points AS ({sql.EACH} SELECT {made}, count(*) AS n_points FROM each_ GROUP BY ALL)
SELECT {key}, m.rate, m.ci_lower, m.ci_upper, 'meta' AS method, m.k, m.model, m.i2, r.rate AS rate_weighted, r.total_sample, g.gmc, g.ci_lower AS gmc_lower, g.ci_upper AS gmc_upper, coalesce(g.n_values, 0) AS n_values, p.n_points
FROM points p LEFT JOIN meta_ m USING ({key}) LEFT JOIN rates r USING ({key}) LEFT JOIN gmcs g USING ({key})"""


@query(_cells_sql("collection_year"))
def year_cells(spark, sf):
    return cells.cell_summary(_scan(spark, sf), ["collection_year"])


@query(_cells_sql("province"))
def region_cells(spark, sf):
    return cells.cell_summary(_scan(spark, sf), ["province"])


@query(_cells_sql("age_band", sql.BAND))
def age_cells(spark, sf):
    mid = stats.age_midpoint(F.col("age_min"), F.col("age_max"))
    return cells.cell_summary(_scan(spark, sf).withColumn("age_band", F.when(mid.isNull(), "unclassified").otherwise(stats.age_band(mid))), ["age_band"])


@query(
    f"""WITH c AS ({_cells_sql("collection_year")}), w AS (SELECT (collection_year - 2000)::DOUBLE AS x, rate AS y, total_sample::DOUBLE AS w, round_even(rate * total_sample / 100, 0) AS cases FROM c WHERE rate IS NOT NULL),
s AS (SELECT count(*) AS k, sum(w) AS sw, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) - sum(w*x)^2/sum(w) AS cxx, sum(w*x*y) - sum(w*x)*sum(w*y)/sum(w) AS cxy, sum(w*y*y) - sum(w*y)^2/sum(w) AS cyy, sum(cases) AS sc, sum(w*x) AS sns, sum(w*x*x) AS snss, sum(cases*x) AS sxs FROM w)
SELECT k, round(cxy/cxx, 6) AS slope, round(cxy*cxy/(cxx*cyy), 6) AS r2, CASE WHEN cxy/cxx > 1e-9 THEN 'up' WHEN cxy/cxx < -1e-9 THEN 'down' ELSE 'flat' END AS direction,
 round((sxs - sc/sw*sns)/sqrt(sc/sw*(1 - sc/sw)*(snss - sns*sns/sw)), 4) AS z FROM s"""
)
def year_trend(spark, sf):
    """Line and trend statistic through the years' meta-merged rates."""
    rows = cells.cell_summary(_scan(spark, sf), ["collection_year"]).withColumn("whole", F.lit(1))
    return cells.trend_of_cells(rows, ["whole"], "collection_year").select("k", "slope", "r2", "direction", "z")


@query(
    f"""{sql.SERO}, b AS (SELECT region, {_BAND_SQL} AS band, sum(p * n) / sum(n) AS r, sum(n) AS n FROM sero WHERE p IS NOT NULL AND n > 0 GROUP BY ALL),
s AS (SELECT b.*, w.w / (SELECT sum(w) FROM (VALUES {", ".join(f"({w})" for _, w, *_ in STANDARD_2020)}) t(w)) AS w FROM b JOIN (VALUES {", ".join(f"('{band}', {w})" for band, w, *_ in STANDARD_2020)}) w(band, w) USING (band)),
a AS (SELECT region, count(*) AS k, sum(r*n)/sum(n) AS c, sum(w*r) AS a, sqrt(sum(w*w*r*(1 - r)/n)) AS e FROM s GROUP BY region)
SELECT region, k AS n_strata, round(c*100, 4) AS crude, round(a*100, 4) AS asr, round((a - 1.959963984540054*e)*100, 4) AS ci_lower, round((a + 1.959963984540054*e)*100, 4) AS ci_upper, round(e*100, 4) AS error FROM a WHERE k >= 3"""
)
def standardised_regions(spark, sf):
    rows = summary.sero(_scan(spark, sf)).where(F.col("p").isNotNull() & (F.col("n") > 0))
    mid = stats.age_midpoint(F.col("age_min"), F.col("age_max"))
    strata = rows.groupBy("region", _band(mid).alias("band")).agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("rate"), F.sum("n").alias("n"))
    return cells.standardised(strata, ["region"], {band: w for band, w, *_ in STANDARD_2020})


@query()
def binomial_intervals(spark, sf):
    """Bounds of the positivity of each disease, province and year: exact ones for few people."""
    rows = summary.sero(_scan(spark, sf)).where(F.col("p").isNotNull())
    sums = rows.groupBy("disease", "province", "collection_year", "assay", "age_min").agg(F.round(F.sum(F.col("p") * F.col("n"))).alias("x"), F.sum("n").alias("n"))
    low, high, method = cells.binomial_interval(F.col("x"), F.col("n"))
    return sums.select("disease", "province", "collection_year", "assay", "age_min", "x", "n", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"), method.alias("method"))


# Gaps

_GAP = f"""{sql.OBS}, f AS (SELECT disease, trim(string_split(province, ';')[1]) AS province, collection_year, review_status, quality_grade FROM obs),
g AS (SELECT province, collection_year, disease, count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'approved' AND quality_grade IN ('A', 'B')) AS approved_ab,
 count(*) FILTER (review_status = 'rejected') AS rejected, count(*) AS total FROM f GROUP BY {{keys}}),
h AS (SELECT *, CASE WHEN approved_ab + pending > 0 THEN greatest(round(least(approved_ab/5, 1)*70 - least(2.0*pending, 30), 2), 0) ELSE 0 END::DOUBLE AS completeness,
 CASE WHEN approved_ab < 5 THEN CASE WHEN approved_ab > 0 AND pending > 0 THEN 'need_both' WHEN pending > 0 THEN 'need_review' ELSE 'need_supplement' END WHEN pending > 0 THEN 'need_review' ELSE 'well_covered' END AS status FROM g)"""
_KEYS = "province, collection_year, disease"


def _counts(spark, sf):
    return gaps.base_counts(observations(spark, sf))


@query(
    f"""{sql.OBS}, p AS (SELECT count(DISTINCT trim(u.p)) AS provinces FROM obs, LATERAL (SELECT unnest(string_split(province, ';')) AS p) u)
SELECT count(*) AS total, count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'rejected') AS rejected,
 count(DISTINCT disease) AS diseases, count(DISTINCT collection_year) AS years, (SELECT provinces FROM p) AS provinces, count(DISTINCT city) AS cities FROM obs"""
)
def gap_overview(spark, sf):
    return gaps.overview(_counts(spark, sf))


@query(f"{_GAP.format(keys=_KEYS)} SELECT * FROM h WHERE status IN ('need_review', 'need_both')")
def gap_review_needed(spark, sf):
    return gaps.review_needed(_counts(spark, sf))


@query(f"{_GAP.format(keys=_KEYS)} SELECT * FROM h WHERE status IN ('need_supplement', 'need_both')")
def gap_supplement_needed(spark, sf):
    return gaps.supplement_needed(_counts(spark, sf))


@query(
    f"""{_GAP.format(keys="GROUPING SETS ((province, collection_year), (province)), disease").replace("SELECT province, collection_year, disease, count", "SELECT province, collection_year, grouping(collection_year) = 1 AS whole, count", 1).replace(", disease),", "),")}
SELECT * FROM h"""
)
def gap_year_matrix(spark, sf):
    return gaps.year_matrix(_counts(spark, sf))


@query(
    f"""{sql.OBS}, c AS (SELECT disease || ' ' || assay AS disease, list_sort(list(DISTINCT trim(u.p))) AS covered FROM obs, LATERAL (SELECT unnest(string_split(province, ';')) AS p) u GROUP BY ALL),
m AS (SELECT *, list_filter((SELECT list(n_name ORDER BY n_name) FROM nation), lambda n: NOT list_contains(covered, n)) AS missing FROM c)
SELECT disease, len(covered) AS n_covered, len(missing) AS n_missing, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) = 0 THEN 100 ELSE least(round(len(covered) / (SELECT count(*) FROM nation) * 100, 2), 100) END::DOUBLE AS percent FROM m"""
)
def gap_coverage(spark, sf):
    """Nations that each disease and assay has facts of, and those it lacks."""
    wanted = sorted(r["n_name"] for r in table(spark, sf, "nation").select("n_name").collect())  # 25 fixed names
    facts = observations(spark, sf).withColumn("disease", F.concat_ws(" ", "disease", "assay"))
    return gaps.coverage(gaps.base_counts(facts), wanted).select("disease", "n_covered", "n_missing", F.array_join("missing", ",").alias("missing"), "percent")


# Names

_RAW = ("ELISA", " elisa kit ", "间接免疫荧光法试剂", "Western Blot", "unheard of", "n", "")
_PLACES = ("广东省", "Guangdong", "青岛市", "内蒙古呼和浩特", "Atlantis", "市", "陇南")
_GROUPS = ("儿童", "农村儿童组", "3-5岁", "≥60岁", "20岁以上成人", "visitors", "军")


@query(
    f"""WITH d AS (SELECT doc_id % 7 AS k, count(*) AS n FROM documents GROUP BY ALL)
SELECT k, n, ['ELISA', 'ELISA', 'IFA', 'WB', 'unheard of', 'NT', NULL][k + 1] AS method, ['广东', '广东', '青海', '内蒙古', 'Atlantis', '北京', '甘肃'][k + 1] AS province, ['儿童', '儿童', '儿童', '老年人', '成人', 'visitors', 'visitors'][k + 1] AS people FROM d WHERE k < 6
UNION ALL SELECT k, n, NULL, '甘肃', '军' FROM d WHERE k = 6"""
)
def standard_names(spark, sf):
    """Names as extractions write them, each rule of the tables taken once, counted over the sources."""
    k = F.col("doc_id") % 7

    def pick(values):
        return F.get(F.array(*map(F.lit, values)), k.cast("int"))

    rows = table(spark, sf, "documents").select(k.alias("k"), names.standard_method(pick(_RAW)).alias("method"), names.standard_province(pick(_PLACES)).alias("province"), names.standard_group(pick(_GROUPS), {"儿童": "儿童", "学生": "学生"}).alias("people"))
    return rows.groupBy("k", "method", "province", "people").agg(F.count("*").alias("n"))


@query(
    f"""{sql.OBS} SELECT province, count(*) AS n, sum(sample_size)::BIGINT AS samples FROM obs WHERE review_status = 'approved' AND estimate_type = 'primary' AND quality_grade IN ('A', 'B') AND disease IN ('PROMO', 'STANDARD')
 AND population ILIKE '%vaccinated%' AND age_min >= 5 AND age_max <= 40 AND collection_year BETWEEN 1994 AND 1997 AND data_type = 'seroprevalence' AND province ILIKE '%nation_1%' GROUP BY province"""
)
def filtered_scan(spark, sf):
    """All predicates of a scan at once; two names of diseases stand for one."""
    rows = scan.base_scan(observations(spark, sf), disease="promo offer", province="nation_1", years=(1994, 1997), ages=(5, 40), data_type="seroprevalence", population="vaccinated,nobody", aliases={"promo": "P", "STANDARD": "P"})
    return rows.groupBy("province").agg(F.count("*").alias("n"), F.sum("sample_size").alias("samples"))
