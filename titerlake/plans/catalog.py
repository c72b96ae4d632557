"""All queries of the library by name, and the DuckDB SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titerlake.functions import parsing, stats, wording
from titerlake.operators import epidemiology, linkage, listing, meta, models, scan, spatial, summary
from titerlake.plans import sql
from titerlake.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from titerlake.sources.adapters import catalogued_sources, dealt, evidence_sources, observations, table, tasks_for
from titerlake.streaming import ingest

GOAL = 95.0
#: Share of each age band in the standard population (a parameter of the standardisation).
STANDARD = {"<1": 0.012, "1-4": 0.056, "5-14": 0.12, "15-59": 0.63, "60+": 0.182}


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    """Approved primary rows of grades A and B, one per province."""
    return scan.split_provinces(scan.base_scan(observations(spark, sf)))


def _studies(spark: SparkSession, sf: str) -> DataFrame:
    rows = summary.sero(_scan(spark, sf))
    return rows.where(F.col("p").isNotNull()).withColumn("x", F.col("p") * F.col("n"))


# Rates, concentrations, maps


@query(f"{sql.SERO} SELECT province, {sql.RATE} FROM sero GROUP BY province")
def region_rate_ci(spark, sf):
    return summary.rate_by(_scan(spark, sf), "province")


@query(f"{sql.EACH} SELECT province, {sql.MAP} FROM each_ GROUP BY province")
def province_map(spark, sf):
    return summary.map_rate_by(_scan(spark, sf), "province")


@query(f"{sql.EACH} SELECT province, city, {sql.MAP} FROM each_ GROUP BY province, city")
def city_map(spark, sf):
    return summary.map_rate_by(_scan(spark, sf), "province", "city")


@query(f"{sql.EACH} SELECT collection_year, {sql.MAP} FROM each_ GROUP BY collection_year")
def yearly_map(spark, sf):
    return summary.map_rate_by(_scan(spark, sf), "collection_year")


@query(f"{sql.SCAN} SELECT disease, {sql.MAP} FROM scan GROUP BY disease")
def national_summary(spark, sf):
    return summary.map_rate_by(scan.base_scan(observations(spark, sf)), "disease")


@query(f"{sql.SCAN} SELECT DISTINCT collection_year FROM scan")
def available_years(spark, sf):
    return scan.base_scan(observations(spark, sf)).select("collection_year").distinct()


@query(f"{sql.SCAN} SELECT population, count(*) AS n FROM scan GROUP BY population")
def population_options(spark, sf):
    return scan.base_scan(observations(spark, sf)).groupBy("population").agg(F.count("*").alias("n"))


@query(f"{sql.SCAN} SELECT collection_year, {sql.GMC} FROM scan WHERE data_type = 'gmc' GROUP BY collection_year")
def year_trend_gmc(spark, sf):
    return summary.gmc_by(scan.base_scan(observations(spark, sf)), "collection_year")


@query(f"{sql.EACH} SELECT disease, province, {sql.GMC} FROM each_ WHERE data_type = 'gmc' GROUP BY disease, province")
def gmc_by_group(spark, sf):
    return summary.gmc_by(_scan(spark, sf), "disease", "province")


@query(f"{sql.SERO} SELECT disease, {sql.BAND} AS age_band, {sql.RATE} FROM sero GROUP BY disease, {sql.BAND}")
def age_stratify(spark, sf):
    mid = stats.age_midpoint(F.col("age_min"), F.col("age_max"))
    return summary.rate_by(_scan(spark, sf), "disease", stats.age_band(mid).alias("age_band"))


@query(
    f"""{sql.SERO} SELECT birth_year, collection_year, count(*) AS n_points, round(sum(p * n) / sum(n) * 100, 2) AS rate
FROM (SELECT *, (collection_year - round_even({sql.MID}, 0))::BIGINT AS birth_year FROM sero WHERE p IS NOT NULL)
GROUP BY birth_year, collection_year HAVING count(*) >= 2"""
)
def birth_cohort_grid(spark, sf):
    mid = stats.age_midpoint(F.col("age_min"), F.col("age_max"))
    rows = _studies(spark, sf).withColumn("birth_year", (F.col("collection_year") - F.bround(mid, 0)).cast("long"))
    cells = rows.groupBy("birth_year", "collection_year").agg(F.count("*").alias("n_points"), F.round(F.sum("x") / F.sum("n") * 100, 2).alias("rate"))
    return cells.where(F.col("n_points") >= 2)


@query(
    f"""{sql.SERO}, strata AS (SELECT region, {sql.BAND} AS band, sum(p * n) / sum(n) AS r FROM sero WHERE p IS NOT NULL GROUP BY ALL)
SELECT region, count(*) AS strata, CASE WHEN count(*) >= 3 THEN round(sum(r * CASE band {" ".join(f"WHEN '{b}' THEN {w}" for b, w in STANDARD.items())} END) * 100, 4) END AS asr
FROM strata GROUP BY region"""
)
def asr_by_region(spark, sf):
    mid = stats.age_midpoint(F.col("age_min"), F.col("age_max"))
    strata = _studies(spark, sf).groupBy("region", stats.age_band(mid).alias("band")).agg((F.sum("x") / F.sum("n")).alias("r"))
    weight = F.create_map(*[F.lit(v) for pair in STANDARD.items() for v in pair])[F.col("band")]
    return strata.groupBy("region").agg(F.count("*").alias("strata"), F.round(F.sum(F.col("r") * weight) * 100, 4).alias("total")).select(
        "region", "strata", F.when(F.col("strata") >= 3, F.col("total")).alias("asr")
    )


# Listings and searches


@query(
    f"{sql.OBS} SELECT source_id, disease, province, value, sample_size FROM obs WHERE review_status = 'approved' "
    "ORDER BY value DESC, source_id, disease, province, sample_size LIMIT 50 OFFSET 50"
)
def approved_page(spark, sf):
    rows = scan.base_scan(observations(spark, sf), include_subgroups=True, grades=None).select("source_id", "disease", "province", "value", "sample_size")
    return scan.page(rows, [F.desc("value"), *map(F.col, ("source_id", "disease", "province", "sample_size"))], 50, 50)


@query(f"{sql.SOURCES} SELECT source_id, title, language, pub_year FROM sources")
def source_list(spark, sf):
    return evidence_sources(spark, sf).select("source_id", "title", "language", "pub_year")


@query(f"{sql.OBS} SELECT disease, assay, count(*) AS n FROM obs WHERE province ILIKE '%build%' OR city ILIKE '%build%' GROUP BY disease, assay")
def fact_search(spark, sf):
    return scan.keyword(observations(spark, sf), "build", ["province", "city"]).groupBy("disease", "assay").agg(F.count("*").alias("n"))


@query(f"{sql.SOURCES} SELECT language, pub_year, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM sources GROUP BY language, pub_year")
def source_counts(spark, sf):
    return evidence_sources(spark, sf).groupBy("language", "pub_year").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# Meta-analysis and tests


@query(
    f"""{sql.SERO}, pts AS (SELECT disease, (collection_year - 1995)::DOUBLE AS x, sum(p * n) / sum(n) * 100 AS y, sum(n) AS w FROM sero WHERE p IS NOT NULL GROUP BY disease, collection_year),
s AS (SELECT disease, count(*) AS k, sum(w) AS sw, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy, sum(w*y*y) AS syy FROM pts GROUP BY disease),
c AS (SELECT disease, k, sxx - sx*sx/sw AS cxx, sxy - sx*sy/sw AS cxy, syy - sy*sy/sw AS cyy FROM s),
b AS (SELECT *, CASE WHEN k >= 2 AND abs(cxx) > 1e-9 THEN cxy/cxx WHEN k >= 2 THEN 0 END AS slope FROM c)
SELECT disease, k, round(slope, 6) AS slope, CASE WHEN abs(cxx) > 1e-9 AND cyy > 1e-9 THEN round(cxy*cxy/(cxx*cyy), 6) END AS r2,
CASE WHEN slope > 1e-9 THEN 'up' WHEN slope < -1e-9 THEN 'down' WHEN slope IS NOT NULL THEN 'flat' END AS direction FROM b"""
)
def linear_trend(spark, sf):
    points = _studies(spark, sf).groupBy("disease", (F.col("collection_year") - 1995).cast("double").alias("x")).agg((F.sum("x") / F.sum("n") * 100).alias("y"), F.sum("n").alias("w"))
    return meta.weighted_trend(points, ["disease"])


@query(
    f"""{sql.SERO}, g AS (SELECT disease, (collection_year - 1995)::DOUBLE AS score, sum(p * n) AS x, sum(n) AS n FROM sero WHERE p IS NOT NULL GROUP BY disease, collection_year),
t AS (SELECT disease, count(*) AS k, sum(n) AS sn, sum(x) AS sx, sum(n*score) AS sns, sum(n*score*score) AS snss, sum(x*score) AS sxs FROM g GROUP BY disease)
SELECT disease, k, CASE WHEN k >= 3 AND sx > 0 AND sx < sn THEN round((sxs - sx/sn*sns) / sqrt(sx/sn*(1 - sx/sn)*(snss - sns*sns/sn)), 4) END AS z FROM t"""
)
def cochran_armitage(spark, sf):
    groups = _studies(spark, sf).groupBy("disease", (F.col("collection_year") - 1995).cast("double").alias("score")).agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return meta.cochran_armitage(groups, ["disease"])


@query(
    f"""{sql.SERO}, c AS (SELECT disease, population, n, round(CASE WHEN value > 1 THEN value ELSE value * 100 END * n, 3) AS hundred FROM sero WHERE p IS NOT NULL),
r AS (SELECT disease, round(sum(hundred) FILTER (population = 'vaccinated') / 100) AS r1, sum(n) FILTER (population = 'vaccinated') AS m1,
 round(sum(hundred) FILTER (population = 'unvaccinated') / 100) AS r2, sum(n) FILTER (population = 'unvaccinated') AS m2 FROM c GROUP BY disease),
a AS (SELECT *, CASE WHEN r1 = 0 OR r1 = m1 THEN r1 + 0.5 ELSE r1 END AS x1, CASE WHEN r1 = 0 OR r1 = m1 THEN m1 + 1 ELSE m1 END AS n1,
 CASE WHEN r2 = 0 OR r2 = m2 THEN r2 + 0.5 ELSE r2 END AS x2, CASE WHEN r2 = 0 OR r2 = m2 THEN m2 + 1 ELSE m2 END AS n2 FROM r)
SELECT disease, r1 AS x1, m1 AS n1, r2 AS x2, m2 AS n2, round((x1/n1 - x2/n2) / sqrt((x1+x2)/(n1+n2)*(1 - (x1+x2)/(n1+n2))*(1/n1 + 1/n2)), 4) AS z, round(x1/n1 - x2/n2, 4) AS rd, round((x1/n1)/(x2/n2), 4) AS rr,
round(greatest(x1/n1 - x2/n2 - 1.96*sqrt(x1/n1*(1 - x1/n1)/n1 + x2/n2*(1 - x2/n2)/n2), -1), 4) AS rd_lower, round(least(x1/n1 - x2/n2 + 1.96*sqrt(x1/n1*(1 - x1/n1)/n1 + x2/n2*(1 - x2/n2)/n2), 1), 4) AS rd_upper,
round(exp(ln((x1/n1)/(x2/n2)) - 1.96*sqrt(1/x1 - 1/n1 + 1/x2 - 1/n2)), 4) AS rr_lower, round(exp(ln((x1/n1)/(x2/n2)) + 1.96*sqrt(1/x1 - 1/n1 + 1/x2 - 1/n2)), 4) AS rr_upper
FROM a"""
)
def two_proportion(spark, sf):
    mine, other = F.col("population") == "vaccinated", F.col("population") == "unvaccinated"
    # percent times n is whole here, so its sum is exact in any order and one division rounds alike everywhere
    rows = _studies(spark, sf).withColumn("hundred", F.round(F.when(F.col("value") > 1, F.col("value")).otherwise(F.col("value") * 100) * F.col("n"), 3))

    def cases(arm: Column) -> Column:
        return F.round(F.sum(F.when(arm, F.col("hundred"))) / 100)

    arms = rows.groupBy("disease").agg(cases(mine).alias("x1"), F.sum(F.when(mine, F.col("n"))).alias("n1"), cases(other).alias("x2"), F.sum(F.when(other, F.col("n"))).alias("n2"))
    return meta.two_proportions(arms)


@query(sql.inverse_variance("disease"))
def inverse_variance_meta(spark, sf):
    return meta.inverse_variance(_studies(spark, sf), ["disease"])


@query(sql.inverse_variance("assay"))
def assay_heterogeneity(spark, sf):
    return meta.inverse_variance(_studies(spark, sf), ["assay"])


@query(sql.double_arcsine("disease"))
def ft_meta_by_group(spark, sf):
    return meta.ft_meta(_studies(spark, sf), ["disease"])


@query(
    f"""{sql.SERO}, t AS (SELECT region, n + 0.5 AS w, asin(sqrt(p*n/(n+1))) + asin(sqrt((p*n+1)/(n+1))) AS t FROM sero WHERE p IS NOT NULL AND n > 0),
s AS (SELECT region, sum(w) AS sw, sum(w*t) AS swt, sum(w*t*t) AS swtt FROM t GROUP BY region),
q AS (SELECT sum(swtt) - sum(swt)*sum(swt)/sum(sw) AS total, sum(swtt - swt*swt/sw) AS within, count(*) - 1 AS df FROM s)
SELECT round(total, 4) AS q_total, round(within, 4) AS q_within, round(greatest(total - within, 0), 4) AS q_between, df FROM q"""
)
def q_between(spark, sf):
    return meta.q_between(_studies(spark, sf), "region")


# Equity, goals, reviews, gaps


@query(f"{sql.SERO}, r AS (SELECT province, {sql.RATE} FROM sero GROUP BY province) SELECT province, rate, CASE WHEN rate IS NOT NULL THEN row_number() OVER (ORDER BY rate DESC NULLS LAST, province) END AS rank FROM r")
def equity_rank(spark, sf):
    return summary.ranked(summary.rate_by(_scan(spark, sf), "province").select("province", "rate"), "rate", "province")


@query(
    f"""{sql.SERO}, r AS (SELECT province, {sql.RATE} FROM sero GROUP BY province), o AS (SELECT rate, row_number() OVER (ORDER BY rate) AS i FROM r WHERE rate >= 0)
SELECT round(greatest(least(2*sum(i*rate)/(count(*)*sum(rate)) - (count(*)+1)/count(*), 1), 0), 6) AS gini, round(coalesce(stddev_samp(rate)/abs(avg(rate)), 0), 6) AS cv, count(*) AS n_groups FROM o"""
)
def gini_cv(spark, sf):
    return summary.gini(summary.rate_by(_scan(spark, sf), "province"), "rate")


@query(
    f"""{sql.SERO}, r AS (SELECT disease, collection_year, province, sum(p*n)/sum(n)*100 AS rate, sum(p*n)*100 AS x, sum(n) AS n FROM sero WHERE p IS NOT NULL GROUP BY ALL)
SELECT disease, collection_year, round({GOAL} - sum(x)/sum(n), 2) AS gap, round(avg((rate >= {GOAL})::INT), 4) AS ratio FROM r GROUP BY disease, collection_year"""
)
def goal_tracking(spark, sf):
    return summary.goals(_studies(spark, sf), GOAL)


@query(f"{sql.OBS} SELECT disease, quality_grade, count(*) AS n, count(*) FILTER (sample_size < 30) AS small FROM obs GROUP BY disease, quality_grade")
def quality_grades(spark, sf):
    return observations(spark, sf).groupBy("disease", "quality_grade").agg(F.count("*").alias("n"), F.count_if(F.col("sample_size") < 30).alias("small"))


@query(
    f"""{sql.OBS} SELECT disease, trim(string_split(province, ';')[1]) AS province, count(*) FILTER (review_status = 'approved' AND quality_grade IN ('A', 'B')) AS approved_ab,
count(*) FILTER (review_status = 'pending') AS pending, count(DISTINCT collection_year) AS years FROM obs GROUP BY ALL"""
)
def coverage_review(spark, sf):
    return summary.gap_counts(observations(spark, sf))


@query(
    f"""{sql.OBS}, g AS (SELECT disease, trim(string_split(province, ';')[1]) AS province, count(*) FILTER (review_status = 'approved' AND quality_grade IN ('A', 'B')) AS a,
count(*) FILTER (review_status = 'pending') AS b FROM obs GROUP BY ALL)
SELECT disease, province, CASE WHEN a + b > 0 THEN greatest(round(least(a/5, 1)*70 - least(2.0*b, 30), 2), 0) ELSE 0 END::DOUBLE AS score FROM g"""
)
def gap_completeness(spark, sf):
    return summary.gap_counts(observations(spark, sf)).select("disease", "province", stats.completeness(F.col("approved_ab"), F.col("pending")).alias("score"))


@query(
    f"""{sql.EACH} SELECT d.disease, d.assay, n.n_name AS province FROM (SELECT DISTINCT disease, assay FROM each_) d, nation n
WHERE NOT EXISTS (SELECT 1 FROM each_ e WHERE e.disease = d.disease AND e.assay = d.assay AND e.province = n.n_name)"""
)
def missing_regions(spark, sf):
    """Nations without a fact, for every disease and assay that has any."""
    found = _scan(spark, sf).select("disease", "assay", "province").distinct()
    names = F.array_sort(F.collect_set("n_name"))  # 25 fixed names in one row
    wanted = found.select("disease", "assay").distinct().withColumn("k", F.lit(1)).join(F.broadcast(table(spark, sf, "nation").agg(names.alias("names")).withColumn("k", F.lit(1))), "k")
    return wanted.select("disease", "assay", F.explode("names").alias("province")).join(found, ["disease", "assay", "province"], "left_anti")


@query(
    f"""{sql.OBS}, d AS (SELECT *, CASE WHEN review_seconds > 0 THEN review_seconds / 60.0 END AS minutes FROM obs WHERE review_status <> 'pending')
SELECT disease, reviewer_id, count(*) AS reviewed, round(avg((review_status = 'approved')::INT), 4) AS pass_rate, round(avg(minutes), 2) AS mean_minutes
FROM d GROUP BY GROUPING SETS ((disease), (reviewer_id), ())"""
)
def review_stats(spark, sf):
    return summary.review_times(observations(spark, sf))


@query(f"{sql.OBS} SELECT review_status, quality_grade, estimate_type, count(*) AS n FROM obs GROUP BY ALL")
def status_combo(spark, sf):
    return observations(spark, sf).groupBy("review_status", "quality_grade", "estimate_type").agg(F.count("*").alias("n"))


# Epidemiology


@query(f"{sql.FOI} SELECT * FROM foi")
def foi_matrix(spark, sf):
    return epidemiology.foi_matrix(_scan(spark, sf))


@query(
    f"""{sql.FOI}, per AS (SELECT disease, round(sum(foi*samples)/sum(samples), 6) AS foi, round(sum(rate*samples)/sum(samples), 2) AS rate FROM foi GROUP BY disease),
h AS (SELECT *, CASE WHEN foi > 0 THEN round(foi*75, 2) END AS r0 FROM per), i AS (SELECT *, CASE WHEN r0 > 1 THEN round((1 - 1/r0)*100, 2) ELSE 0 END AS hit FROM h)
SELECT disease, foi, rate, r0, hit, CASE WHEN rate IS NULL THEN 'undetermined' WHEN rate >= hit THEN 'reached' WHEN rate >= hit - 10 THEN 'near' ELSE 'not_reached' END AS status FROM i"""
)
def barrier_by_disease(spark, sf):
    return epidemiology.barrier(epidemiology.foi_matrix(_scan(spark, sf)))


_VE = f"""{sql.EACH}, v AS (SELECT disease, round(sum(value*sample_size) FILTER (population = 'vaccinated') / sum(sample_size) FILTER (population = 'vaccinated'), 2) AS vaccinated,
round(sum(value*sample_size) FILTER (population = 'unvaccinated') / sum(sample_size) FILTER (population = 'unvaccinated'), 2) AS unvaccinated
FROM each_ WHERE data_type = 'seroprevalence' GROUP BY disease)"""


@query(f"{_VE} SELECT *, CASE WHEN unvaccinated > 0 AND vaccinated/unvaccinated < 1 THEN round((1 - vaccinated/unvaccinated)*100, 2) END AS effect FROM v")
def vaccine_effect(spark, sf):
    return epidemiology.vaccine_effect(_scan(spark, sf))


@query(
    f"""{sql.SERO}, r AS (SELECT disease, {sql.RATE} FROM sero GROUP BY disease), c AS (SELECT disease, rate, CASE WHEN rate/100 >= 0.95 THEN 0 ELSE (0.95 - rate/100)/(1 - rate/100)*100 END AS need FROM r)
SELECT disease, rate, round(rate + (1 - rate/100)*50, 4) AS effective, CASE WHEN need <= 100 THEN round(need, 2) END AS required FROM c"""
)
def booster_scenario(spark, sf):
    return epidemiology.booster(summary.rate_by(_scan(spark, sf), "disease").select("disease", "rate"), 50.0, GOAL)


# Scores and texts


@query(
    f"""{sql.OBS}, s AS (SELECT disease, CASE WHEN sample_size >= 2001 THEN 30 WHEN sample_size >= 500 THEN 24 WHEN sample_size >= 100 THEN 16 WHEN sample_size >= 1 THEN 8 ELSE 0 END
+ CASE confidence WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END AS score FROM obs)
SELECT disease, score, CASE WHEN score >= 75 THEN 'A' WHEN score >= 50 THEN 'B' ELSE 'C' END AS grade, count(*) AS n FROM s GROUP BY ALL"""
)
def quality_score(spark, sf):
    scores = observations(spark, sf).select("disease", (wording.score_sample_size(F.col("sample_size")) + wording.score_confidence(F.col("confidence"))).alias("score"))
    return scores.groupBy("disease", "score").agg(F.count("*").alias("n")).select("disease", "score", wording.grade(F.col("score")).alias("grade"), "n")


@query(f"{sql.SOURCES} SELECT source_id, {sql.NORMAL_TITLE} AS normal, {sql.SURNAME} AS surname FROM sources")
def title_normalise(spark, sf):
    return evidence_sources(spark, sf).select("source_id", wording.normal_title(F.col("title")).alias("normal"), wording.surname(F.col("authors")).alias("surname"))


@query(
    r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'zh' ELSE 'en' END AS vote FROM documents"""
)
def language_vote(spark, sf):
    return table(spark, sf, "documents").select("doc_id", wording.language_vote(F.col("text")).alias("vote"))


@query(
    r"""SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id,
trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS t FROM documents)"""
)
def text_clean(spark, sf):
    clean = wording.clean(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("text_md5"))


@query(
    """SELECT doc_id, u.chunk, length(substr(text, u.chunk*width + 1, width)) AS n_chars, md5(substr(text, u.chunk*width + 1, width)) AS text_md5
FROM (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN length(coalesce(text, '')) > 20000 THEN 15000 ELSE 20000 END AS width FROM documents) d,
LATERAL (SELECT unnest(range(greatest((length(d.text) + d.width - 1) // d.width, 1))) AS chunk) u"""
)
def chunk_table(spark, sf):
    return wording.chunks(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "chunk", F.length("part").cast("long").alias("n_chars"), F.md5("part").alias("text_md5"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", wording.html_title(F.col("html")).alias("title"))


# Linkage and provenance


@query(
    f"""{sql.SOURCES}, t AS (SELECT source_id, coalesce({sql.SURNAME}, '') AS who, list_sort(list_distinct(list_filter(string_split({sql.NORMAL_TITLE}, ' '), lambda x: x <> ''))) AS tokens FROM sources),
c AS (SELECT who, tokens, min(source_id) AS id, count(*) AS copies FROM t WHERE len(tokens) > 0 GROUP BY who, tokens),
p AS (SELECT x.id AS a, y.id AS b, x.copies AS copies_a, y.copies AS copies_b, len(list_intersect(x.tokens, y.tokens)) AS i, len(x.tokens) + len(y.tokens) AS s FROM c x JOIN c y ON x.who = y.who AND x.id < y.id)
SELECT a, b, copies_a, copies_b, round(i / (s - i), 4) AS similarity FROM p WHERE i / (s - i) >= 0.7"""
)
def duplicate_pairs(spark, sf):
    return linkage.title_pairs(evidence_sources(spark, sf))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return linkage.same_text_groups(evidence_sources(spark, sf).where(F.col("text").isNotNull()))


@query(f"{sql.OBS} SELECT source_id, disease, province, count(*) AS n_rows, count(DISTINCT value) AS n_values FROM obs WHERE data_type = 'seroprevalence' GROUP BY ALL HAVING count(DISTINCT value) > 1")
def merge_conflicts(spark, sf):
    return linkage.conflict_groups(observations(spark, sf).where(F.col("data_type") == "seroprevalence"), ["source_id", "disease", "province"], "value")


@query(
    f"""{sql.OBS}, parents AS (SELECT source_id, region, min(value) AS parent_value FROM obs WHERE estimate_type = 'primary' GROUP BY ALL)
SELECT o.region, count(*) AS children, count(parent_value) AS linked, round(sum(parent_value), 2) AS parent_sum FROM obs o LEFT JOIN parents USING (source_id, region) WHERE estimate_type = 'subgroup' GROUP BY o.region"""
)
def parent_link(spark, sf):
    obs = observations(spark, sf).select("source_id", "region", "estimate_type", "value")
    linked = linkage.link_parents(obs, ["source_id", "region"], "value")
    return linked.groupBy("region").agg(F.count("*").alias("children"), F.count("parent_value").alias("linked"), F.round(F.sum("parent_value"), 2).alias("parent_sum"))


@query(
    r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) || ' ' AS t FROM documents),
b AS (SELECT item_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON b.t <> '' AND contains(d.t, ' ' || b.t || ' ')"""
)
def exact_provenance(spark, sf):
    return linkage.contained_passages(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text"))


@query(
    f"""{sql.OBS} SELECT disease, province, city, age_min, age_max, data_type, max(value) AS value, count(*) AS n FROM obs GROUP BY disease, province, city, age_min, age_max, data_type"""
)
def multi_pass_dedupe(spark, sf):
    keys = ["disease", "province", "city", "age_min", "age_max", "data_type"]
    return observations(spark, sf).groupBy(*keys).agg(F.max("value").alias("value"), F.count("*").alias("n"))


@query(
    f"""{sql.OBS}, c AS (SELECT disease, assay, count(*) AS n FROM obs GROUP BY ALL)
SELECT disease, assay, n FROM c QUALIFY row_number() OVER (PARTITION BY disease ORDER BY n DESC, assay) = 1"""
)
def metadata_mode(spark, sf):
    counts = observations(spark, sf).groupBy("disease", "assay").agg(F.count("*").alias("n"))
    return linkage.first_by_key(counts, ["disease"], [F.desc("n"), F.col("assay")])


@query(
    f"""{sql.OBS} SELECT disease, count(*) AS n, sum(('0x' || substr(md5(source_id || '|' || review_status || '|' || sample_size), 1, 12))::BIGINT)::VARCHAR AS fingerprint FROM obs GROUP BY disease"""
)
def fingerprint(spark, sf):
    text = F.concat_ws("|", F.col("source_id"), "review_status", F.col("sample_size"))
    part = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(20,0)")
    return observations(spark, sf).groupBy("disease").agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("fingerprint"))


# Space, titers, models


def _places(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Rates of nations, and edges between nations of a region (25 rows)."""
    nation = table(spark, sf, "nation")
    a, b = (nation.select(F.col("n_name").alias(x), "n_regionkey") for x in ("src", "dst"))
    edges = a.join(b, "n_regionkey").where(F.col("src") != F.col("dst")).select("src", "dst")
    rates = summary.rate_by(scan.base_scan(observations(spark, sf)), "province").join(nation.select(F.col("n_name").alias("province")), "province", "left_semi")
    return rates.select(F.col("province").alias("place"), F.col("rate").alias("x")), edges


@query(
    f"""{sql.PLACES}, l AS (SELECT src, x.x AS xs, avg(y.x) AS lag FROM edges JOIN v x ON x.place = src JOIN v y ON y.place = dst GROUP BY src, x.x), m AS (SELECT avg(x) AS m, count(*) AS n FROM v)
SELECT (SELECT n FROM m) AS n, CASE WHEN (SELECT n FROM m) >= 8 THEN round((SELECT n FROM m) * (SELECT sum((xs - m.m)*(lag - m.m)) FROM l, m) / ((SELECT count(*) FROM l) * (SELECT sum((v.x - m.m)^2) FROM v, m)), 6) END AS morans_i"""
)
def moran_i(spark, sf):
    return spatial.morans_i(*_places(spark, sf))


@query(
    f"""{sql.PLACES}, m AS (SELECT avg(x) AS m, count(*) AS n, stddev_pop(x) AS s FROM v), near AS (SELECT src, dst FROM edges UNION SELECT place, place FROM v),
g AS (SELECT src, sum(x) AS sx, count(*) AS w FROM near JOIN v ON place = dst GROUP BY src),
z AS (SELECT src AS place, round((sx - m*w) / (s * sqrt((n*w - w*w) / (n - 1))), 4) AS z FROM g, m)
SELECT place, z, CASE WHEN abs(z) >= 1.645 THEN CASE WHEN z > 0 THEN 'hot_' ELSE 'cold_' END || CASE WHEN abs(z) >= 2.576 THEN '99' WHEN abs(z) >= 1.96 THEN '95' ELSE '90' END ELSE 'none' END AS cluster FROM z"""
)
def gi_star(spark, sf):
    return spatial.gi_star(*_places(spark, sf))


def _titers(spark: SparkSession, sf: str) -> DataFrame:
    """Titers of label (antigen) by dimension (serum), over all dimensions."""
    cells = table(spark, sf, "embeddings").select(F.col("label").alias("antigen"), F.posexplode("embedding").alias("serum", "e"))
    return cells.groupBy("antigen", "serum").agg((10 + 1000 * F.abs(F.avg(F.col("e").cast("double")))).alias("titer"))


@query(f"{sql.TITERS} SELECT antigen, serum, round(top - lt, 6) AS distance FROM t")
def titer_distance(spark, sf):
    return spatial.titer_distances(_titers(spark, sf))


@query(f"{sql.TITERS}, d AS (SELECT antigen, serum, round(top - lt, 6) AS distance FROM t) SELECT x.antigen AS a, y.antigen AS b, round(sqrt(sum((x.distance - y.distance)^2)), 4) AS distance FROM d x JOIN d y ON x.serum = y.serum AND x.antigen < y.antigen GROUP BY x.antigen, y.antigen")
def joint_distance(spark, sf):
    return spatial.antigen_distances(spatial.titer_distances(_titers(spark, sf)))


@query()
def catalytic_fit(spark, sf):
    mid = stats.age_midpoint(F.col("age_min"), F.col("age_max"))
    points = _studies(spark, sf).withColumn("age", F.floor(mid) + 0.5).groupBy("disease", "age").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return models.catalytic_models(points)


@query()
def lowess_by_region(spark, sf):
    points = _studies(spark, sf).groupBy(F.col("region").alias("key"), F.col("collection_year").cast("double").alias("x")).agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("y"))
    return models.lowess(points)


# Streams


@query("SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, count(*) AS n, count(*) > 5 AS limited FROM events GROUP BY ALL")
def rate_window(spark, sf):
    return ingest.rate_windows(table(spark, sf, "events")).withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query(f"{sql.OBS} SELECT review_status, disease, count(*) AS n FROM obs GROUP BY ALL")
def gauges(spark, sf):
    return ingest.gauges(observations(spark, sf))


# Listings of sources with every predicate


def _catalogued(spark: SparkSession, sf: str) -> DataFrame:
    return listing.with_counters(catalogued_sources(spark, sf), observations(spark, sf), tasks_for(spark, sf, "lineitem"))


@query(f"{sql.CATALOGUED} SELECT source_id, title, pub_year, form, state, (SELECT count(*) FROM cat WHERE deleted_at IS NULL) AS total FROM cat WHERE deleted_at IS NULL ORDER BY pub_year DESC NULLS LAST, created_at DESC, source_id LIMIT 20 OFFSET 20")
def source_page(spark, sf):
    rows = listing.list_sources(_catalogued(spark, sf))
    page = listing.paged(rows, [listing.sort_key("pub_year", True), F.desc("created_at"), F.col("source_id")], 2, 20)
    return page.select("source_id", "title", "pub_year", parsing.file_format(F.col("file_path")).alias("form"), parsing.review_state(F.col("extracted"), F.col("approved")).alias("state"), "total")


@query(
    f"""{sql.CATALOGUED} SELECT source_id, extracted, approved, form, total FROM (SELECT *, count(*) OVER () AS total FROM cat WHERE deleted_at IS NULL AND extracted > 0)
ORDER BY approved / extracted DESC NULLS LAST, form NULLS LAST, source_id LIMIT 30"""
)
def source_progress_page(spark, sf):
    rows = listing.list_sources(_catalogued(spark, sf)).where(F.col("extracted") > 0)
    page = listing.paged(rows, [listing.sort_key("progress", True), listing.sort_key("format"), F.col("source_id")], 1, 30)
    return page.select("source_id", "extracted", "approved", parsing.file_format(F.col("file_path")).alias("form"), "total")


@query(
    f"""{sql.CATALOGUED} SELECT source_id, 'keyword' AS test FROM cat WHERE deleted_at IS NULL AND (title ILIKE '%the%' OR authors ILIKE '%the%' OR abstract ILIKE '%the%' OR array_to_string(keywords, ' ') ILIKE '%the%')
UNION ALL SELECT source_id, 'text' FROM cat WHERE deleted_at IS NULL AND title ILIKE '%on%' AND authors ILIKE '%e%' AND language = 'en'
UNION ALL SELECT source_id, 'years' FROM cat WHERE deleted_at IS NULL AND pub_year BETWEEN 1995 AND 2005
UNION ALL SELECT source_id, 'created' FROM cat WHERE deleted_at IS NULL AND created_at >= DATE '2020-03-01' AND created_at < DATE '2020-04-16'
UNION ALL SELECT source_id, state FROM cat WHERE deleted_at IS NULL
UNION ALL SELECT source_id, coalesce(form, '?') FROM cat WHERE deleted_at IS NULL AND (form IS NOT NULL OR file_path IS NULL)
UNION ALL SELECT source_id, CASE WHEN coalesce(abstract, '') <> '' THEN 'abstract' ELSE 'no abstract' END FROM cat WHERE deleted_at IS NULL
UNION ALL SELECT source_id, 'tagged' FROM cat WHERE deleted_at IS NULL AND source_id IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT source_id, 'disease' FROM cat WHERE deleted_at IS NULL AND source_id IN (SELECT source_id FROM obs WHERE disease = 'PROMO')
UNION ALL SELECT source_id, 'bin' FROM cat WHERE deleted_at IS NOT NULL"""
)
def source_predicates(spark, sf):
    """Each predicate of the listing on its own."""
    rows, facts = _catalogued(spark, sf), observations(spark, sf)
    tags = table(spark, sf, "labels").where(F.col("quality") == 0).select(F.col("doc_id").alias("source_id"))
    tests = {
        "keyword": {"keyword": "the"}, "text": {"title": "on", "authors": "e", "language": "en"}, "years": {"years": (1995, 2005)}, "created": {"created": ("2020-03-01", "2020-04-15")},
        **{s: {"state": s} for s in ("none", "pending", "partial", "approved")}, **{f: {"form": f} for f in ("PDF", "DOCX", "TXT", "HTML", "URL")}, "?": {"form": listing.WITHOUT_FORMAT},
        "abstract": {"has_abstract": True}, "no abstract": {"has_abstract": False}, "tagged": {"tags": tags}, "disease": {"with_facts": dealt(facts.where(F.col("disease") == "PROMO").select("source_id"), tasks_for(spark, sf, "lineitem"), "source_id")}, "bin": {"deleted": True},
    }
    out = None
    for name, test in tests.items():
        part = listing.list_sources(rows, **test).select("source_id", F.lit(name).alias("test"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""{sql.CATALOGUED} SELECT o.source_id, s.title, o.disease, o.value, (SELECT count(*) FROM obs WHERE review_status = 'pending') AS total FROM obs o LEFT JOIN sources s USING (source_id)
WHERE review_status = 'pending' ORDER BY o.source_id, o.value DESC NULLS LAST, o.disease, o.province LIMIT 50"""
)
def titled_facts(spark, sf):
    facts = observations(spark, sf).where(F.col("review_status") == "pending")
    page = listing.paged(facts, [F.col("source_id"), F.col("value").desc_nulls_last(), F.col("disease"), F.col("province")], 1, 50)
    return listing.titled(page, evidence_sources(spark, sf)).select("source_id", "title", "disease", "value", "total")


@query(f"{sql.CATALOGUED} SELECT source_id, file_path IS NULL AND coalesce(abstract, '') = '' AS empty, coalesce(deleted_at < DATE '2021-07-20' - 30, false) AS expired FROM cat WHERE (file_path IS NULL AND coalesce(abstract, '') = '') OR deleted_at < DATE '2021-07-20' - 30")
def maintenance_lists(spark, sf):
    rows = catalogued_sources(spark, sf)
    empty = listing.empty_sources(rows).select("source_id", F.lit(True).alias("empty"))
    gone = listing.expired(rows, "2021-07-20").select("source_id", F.lit(True).alias("expired"))
    return empty.join(gone, "source_id", "full").select("source_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("empty", "expired")])


# Scores, statuses, summaries

_METHODS = ["brand#1", "brand#2", "Brand#3", "Brand#4", "Brand#5"]


@query(
    f"""{sql.OBS}, f AS (SELECT o.*, d.text FROM obs o LEFT JOIN documents d ON d.doc_id = o.source_id),
s AS (SELECT disease, CASE WHEN sample_size >= 2001 THEN 30 WHEN sample_size >= 500 THEN 24 WHEN sample_size >= 100 THEN 16 WHEN sample_size >= 1 THEN 8 ELSE 0 END AS size,
CASE WHEN regexp_matches(design, '{wording.SAMPLED_WELL}') THEN 25 WHEN regexp_matches(design, '{wording.SAMPLED_POORLY}') THEN 6 ELSE 12 END AS sampling,
CASE WHEN coalesce(trim(assay), '') = '' THEN 0 WHEN upper(trim(assay)) IN ('BRAND#1', 'BRAND#2', 'BRAND#3', 'BRAND#4', 'BRAND#5') THEN 15 ELSE 8 END AS method,
CASE WHEN regexp_matches(people, '{wording.PEOPLE_AT_LARGE}') THEN 15 WHEN regexp_matches(people, '{wording.PEOPLE_IN_CARE}') THEN 5 ELSE 8 END AS population,
CASE WHEN level = 'national' THEN 10 WHEN level = 'provincial' THEN 8 ELSE 5 END AS survey, CASE confidence WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END AS sure
FROM (SELECT *, CASE source_id % 3 WHEN 0 THEN 'A stratified design' WHEN 1 THEN 'convenience sample' ELSE text END AS design, CASE WHEN population = 'vaccinated' THEN 'hospital staff' ELSE population END AS people,
 CASE WHEN len(string_split(province, ';')) = 1 AND source_id % 4 = 0 THEN 'provincial' WHEN size0 >= 2000 THEN 'provincial' ELSE 'local' END AS level,
 FROM (SELECT * REPLACE (size0 AS sample_size) FROM (SELECT *, sample_size * (1 + source_id % 60) AS size0 FROM f))))
SELECT disease, grade, count(*) AS n, min(total) AS least, max(total) AS most FROM (SELECT disease, total, CASE WHEN total >= 75 THEN 'A' WHEN total >= 50 THEN 'B' ELSE 'C' END AS grade
FROM (SELECT disease, size + sampling + method + population + survey + sure AS total FROM s)) GROUP BY disease, grade"""
)
def quality_score_full(spark, sf):
    """All six parts of the score; design, people and number of cities vary by source so that every grade occurs."""
    rows = observations(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text"), "source_id", "left")
    i = F.col("source_id")
    rows = rows.withColumns({
        "sample_size": (F.col("sample_size") * (1 + i % 60)).cast("long"),
        "design": F.when(i % 3 == 0, "A stratified design").when(i % 3 == 1, "convenience sample").otherwise(F.col("text")),
        "people": F.when(F.col("population") == "vaccinated", "hospital staff").otherwise(F.col("population")),
        "cities": F.when(i % 4 == 0, F.concat_ws("、", "city", F.lit("other"))).otherwise(F.col("city")),
    })
    level = wording.survey_level(F.col("province"), F.col("cities"), F.col("sample_size"))
    parts = [
        wording.score_sample_size(F.col("sample_size")), wording.score_sampling(F.col("design")), wording.score_method(F.col("assay"), _METHODS),
        wording.score_population(F.col("people")), wording.score_level(level), wording.score_confidence(F.col("confidence")),
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    scored = rows.select("disease", total.alias("total"))
    return scored.groupBy("disease", wording.grade(F.col("total")).alias("grade")).agg(F.count("*").alias("n"), F.min("total").alias("least"), F.max("total").alias("most"))


@query(
    f"""{sql.OBS}, g AS (SELECT disease, trim(string_split(province, ';')[1]) AS province, count(*) FILTER (review_status = 'approved' AND quality_grade IN ('A', 'B')) AS a, count(*) FILTER (review_status = 'pending') AS b FROM obs GROUP BY ALL)
SELECT disease, province, a, b, CASE WHEN a = 0 AND b = 0 THEN 'need_supplement' WHEN a = 0 THEN 'need_review' WHEN a < 5 AND b > 0 THEN 'need_both' WHEN a < 5 THEN 'need_supplement' WHEN b > 0 THEN 'need_review' ELSE 'well_covered' END AS status FROM g"""
)
def gap_status(spark, sf):
    counts = summary.gap_counts(observations(spark, sf))
    return counts.select("disease", "province", F.col("approved_ab").alias("a"), F.col("pending").alias("b"), stats.status_label(F.col("approved_ab"), F.col("pending")).alias("status"))


@query(f"{sql.OBS} SELECT disease, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'rejected') AS rejected, coalesce(sum(sample_size) FILTER (review_status = 'approved'), 0)::BIGINT AS approved_samples, sum(sample_size)::BIGINT AS samples FROM obs GROUP BY disease")
def review_coverage(spark, sf):
    status = F.col("review_status")
    return observations(spark, sf).groupBy("disease").agg(
        *[F.count_if(status == s).alias(s) for s in ("approved", "pending", "rejected")],
        F.coalesce(F.sum(F.when(status == "approved", F.col("sample_size"))), F.lit(0)).alias("approved_samples"), F.sum("sample_size").alias("samples"),
    )


@query(
    f"""{sql.SERO}, r AS (SELECT disease, {sql.RATE}, count(DISTINCT source_id) AS n_sources, round(min(p) * 100, 2) AS least, round(max(p) * 100, 2) AS most FROM sero GROUP BY disease) SELECT * FROM r"""
)
def disease_summary(spark, sf):
    rows = summary.sero(_scan(spark, sf))
    rate = stats.weighted_rate(F.col("p"), F.col("n"))
    return rows.groupBy("disease").agg(
        *[c.alias(k) for k, c in rate.items()], F.count("*").alias("n_points"), F.countDistinct("source_id").alias("n_sources"), F.round(F.min("p") * 100, 2).alias("least"), F.round(F.max("p") * 100, 2).alias("most")
    )


@query(f"{sql.SERO}, a AS (SELECT province, n, CASE WHEN p IN (0, 1) THEN (p*n + 0.5)/(n + 1) ELSE p END AS p, CASE WHEN p IN (0, 1) THEN n + 1 ELSE n END AS m FROM sero WHERE p IS NOT NULL AND n > 0), s AS (SELECT province, count(*) AS n_studies, sum(n) AS t, sum(m/(1 - p))/sum(m/(p*(1 - p))) AS q FROM a GROUP BY province) SELECT province, n_studies, round(q, 6) AS pooled, round(greatest((q + 1.96*1.96/(2*t) - 1.96*sqrt(q*(1 - q)/t + 1.96*1.96/(4*t*t)))/(1 + 1.96*1.96/t), 0), 6) AS ci_lower, round(least((q + 1.96*1.96/(2*t) + 1.96*sqrt(q*(1 - q)/t + 1.96*1.96/(4*t*t)))/(1 + 1.96*1.96/t), 1), 6) AS ci_upper FROM s")
def pooled_proportion(spark, sf):
    return meta.pooled_wilson(_studies(spark, sf), ["province"])


@query(f"{sql.SERO}, s AS (SELECT disease, source_id, n/(p*(1 - p)) AS w FROM sero WHERE n > 0 AND p > 0 AND p < 1), t AS (SELECT disease, round(100*w/sum(w) OVER (PARTITION BY disease), 6) AS weight FROM s) SELECT disease, count(*) AS k, round(max(weight), 5) AS largest FROM t GROUP BY disease")
def largest_study_weight(spark, sf):
    rows = meta.study_weights(_studies(spark, sf), ["disease"])
    return rows.groupBy("disease").agg(F.count("*").alias("k"), F.round(F.max("weight"), 5).alias("largest"))


@query(f"{sql.SERO}, r AS (SELECT province, {sql.RATE} FROM sero GROUP BY province), k AS (SELECT province, rate, row_number() OVER (ORDER BY rate DESC NULLS LAST, province) AS up, row_number() OVER (ORDER BY rate NULLS LAST, province) AS down FROM r) SELECT province, rate, up <= 5 AS top, down <= 5 AS bottom FROM k WHERE up <= 5 OR down <= 5")
def top_and_bottom(spark, sf):
    rates = summary.rate_by(_scan(spark, sf), "province").select("province", "rate")
    up, down = (rates.orderBy(o, "province").limit(5).select("province", F.lit(True).alias(n)) for o, n in ((F.desc_nulls_last("rate"), "top"), (F.asc_nulls_last("rate"), "bottom")))
    ends = up.join(down, "province", "full")
    return rates.join(ends, "province").select("province", "rate", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("top", "bottom")])


@query(
    f"""{sql.SERO}, a AS (SELECT DISTINCT disease, {sql.MID} AS age FROM sero WHERE p IS NOT NULL), g AS (SELECT disease, age - lag(age) OVER (PARTITION BY disease ORDER BY age) AS gap FROM a)
SELECT disease, max(gap) AS gap, coalesce(max(gap) > 10, false) AS sparse FROM g GROUP BY disease"""
)
def age_gaps(spark, sf):
    ages = _studies(spark, sf).select("disease", stats.age_midpoint(F.col("age_min"), F.col("age_max")).alias("age")).distinct()
    gaps = ages.withColumn("gap", F.col("age") - F.lag("age").over(W.partitionBy("disease").orderBy("age")))
    return gaps.groupBy("disease").agg(F.max("gap").alias("gap"), F.coalesce(F.max("gap") > 10, F.lit(False)).alias("sparse"))


@query(f"{sql.SERO} SELECT (floor((collection_year - round_even({sql.MID}, 0)) / 10) * 10)::BIGINT || 's' AS decade, count(*) AS n FROM sero GROUP BY ALL")
def birth_decades(spark, sf):
    mid = stats.age_midpoint(F.col("age_min"), F.col("age_max"))
    year = (F.col("collection_year") - F.bround(mid, 0)).cast("long")
    return summary.sero(_scan(spark, sf)).groupBy(stats.decade(year).alias("decade")).agg(F.count("*").alias("n"))


@query(
    f"""{sql.OBS} SELECT disease, sum(value_or_null IS NULL)::BIGINT AS blank, count(*) AS n FROM (SELECT disease, CASE WHEN value <> 0 THEN value END AS value_or_null FROM obs) GROUP BY disease"""
)
def falsy_values(spark, sf):
    return observations(spark, sf).groupBy("disease").agg(F.count_if(F.nullif(F.col("value"), F.lit(0.0)).isNull()).alias("blank"), F.count("*").alias("n"))


@query(f"{sql.OBS} SELECT assay, count(*) AS n, CASE WHEN assay = 'Brand#1' THEN 'one' WHEN contains(lower(assay), 'brand#2') THEN 'two' WHEN contains(lower(assay), 'brand#1') THEN 'one' ELSE assay END AS standard FROM obs GROUP BY assay")
def assay_aliases(spark, sf):
    standard = parsing.alias_by_longest(F.col("assay"), {"Brand#1": "one", "brand#2": "two", "b": "short"})
    return observations(spark, sf).groupBy("assay").agg(F.count("*").alias("n")).withColumn("standard", standard)


@query()
def trend_with_p(spark, sf):
    points = _studies(spark, sf).groupBy("disease", (F.col("collection_year") - 1995).cast("double").alias("x")).agg((F.sum("x") / F.sum("n") * 100).alias("y"), F.sum("n").alias("w"))
    return meta.trend_p_value(meta.weighted_trend(points, ["disease"]))


@query()
def gmc_t_interval(spark, sf):
    rows = scan.base_scan(observations(spark, sf)).where(F.col("data_type") == "gmc")
    return rows.groupBy("disease", "collection_year", "assay").agg(*[c.alias(k) for k, c in stats.gmc_t(F.col("value")).items()])


# Small-study effects, merges, passes, levels, checks


@query(
    f"""{sql.SERO}, s AS (SELECT disease, sqrt(n) AS s, sqrt(n + 0.5) AS w, asin(sqrt(p*n/(n + 1))) + asin(sqrt((p*n + 1)/(n + 1))) AS t FROM sero WHERE p IS NOT NULL AND n > 0),
m AS (SELECT disease, count(*) AS k, sum(w) AS sw, sum(w*t)/sum(w) AS mt, sum(w*s)/sum(w) AS ms, sum(w*t*s) AS wts, sum(w*s*s) AS wss, sum(w*t*t) AS wtt FROM s GROUP BY disease),
c AS (SELECT *, wts/sw - mt*ms AS cov, wss/sw - ms*ms AS var, wtt/sw - mt*mt AS spread FROM m),
b AS (SELECT *, cov/var AS slope, mt - cov/var*ms AS a, sqrt(sw*(spread - cov/var*cov)/(k - 2)*(1/sw + ms*ms/(sw*var))) AS e FROM c WHERE k >= 10)
SELECT disease, k, round(a, 4) AS intercept, round(slope, 6) AS slope, round(e, 6) AS error, round(a/e, 4) AS t FROM b"""
)
def egger_intercept(spark, sf):
    return meta.egger(_studies(spark, sf), ["disease"]).drop("p_value")


@query(
    f"""{sql.OBS} SELECT x.source_id AS a, y.source_id AS b, x.disease, x.province, x.collection_year, x.data_type, x.value AS value_a, x.sample_size AS size_a, y.value AS value_b, y.sample_size AS size_b
FROM obs x JOIN obs y ON y.source_id = x.source_id + 1 AND x.source_id % 2 = 0 AND x.disease IS NOT DISTINCT FROM y.disease AND x.province IS NOT DISTINCT FROM y.province
 AND x.collection_year IS NOT DISTINCT FROM y.collection_year AND x.data_type IS NOT DISTINCT FROM y.data_type"""
)
def merge_preview(spark, sf):
    facts, tasks = observations(spark, sf), tasks_for(spark, sf, "lineitem")
    targets = dealt(facts.select("source_id").where(F.col("source_id") % 2 == 0), tasks, "source_id").distinct()  # each even source and the next one
    return linkage.merge_preview(facts, targets.select(F.col("source_id").alias("a"), (F.col("source_id") + 1).alias("b")), tasks)


@query(
    f"""{sql.OBS}, r AS (SELECT *, CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS pass FROM obs)
SELECT disease, province, city, age_min, age_max, data_type, value, pass, source_id, n FROM (SELECT *, count(*) OVER k AS n, row_number() OVER (k ORDER BY pass, source_id) AS i FROM r
 WINDOW k AS (PARTITION BY disease, province, city, age_min, age_max, data_type, value)) WHERE i = 1"""
)
def first_of_passes(spark, sf):
    rows = observations(spark, sf)
    passes = [rows.where(F.col("confidence") == c) for c in ("high", "medium", "low")]
    return linkage.first_of_passes(passes, ["disease", "province", "city", "age_min", "age_max", "data_type", "value"], "source_id", tasks_for(spark, sf, "lineitem"))


@query(
    f"""{sql.EACH}, f AS (SELECT disease, collection_year, province, value, sample_size::DOUBLE AS w, CASE WHEN {sql.MID} <= 0 THEN NULL WHEN value <= 0 THEN 0 ELSE -ln(1 - least(value, 99.99) / 100) / {sql.MID} END AS f
 FROM each_ WHERE data_type = 'seroprevalence' AND sample_size > 0),
g AS (SELECT disease, collection_year, province, CASE WHEN grouping(collection_year) = 0 THEN 'year' WHEN grouping(province) = 0 THEN 'province' ELSE 'overall' END AS level,
 round(sum(f*w) / sum(w) FILTER (f IS NOT NULL), 6) AS foi, round(sum(value*w) / sum(w), 2) AS rate FROM f GROUP BY GROUPING SETS ((disease), (disease, collection_year), (disease, province))),
h AS (SELECT *, CASE WHEN foi > 0 THEN round(foi*75, 2) END AS r0 FROM g), i AS (SELECT *, CASE WHEN r0 > 1 THEN round((1 - 1/r0)*100, 2) ELSE 0 END AS hit FROM h)
SELECT *, CASE WHEN rate IS NULL THEN 'undetermined' WHEN rate >= hit THEN 'reached' WHEN rate >= hit - 10 THEN 'near' ELSE 'not_reached' END AS status FROM i"""
)
def barrier_levels(spark, sf):
    return epidemiology.barrier_levels(_scan(spark, sf))


@query(
    f"""{sql.OBS}, c AS (SELECT disease, province NOT IN (SELECT n_name FROM nation) AS place, NOT (CASE WHEN data_type = 'gmc' THEN value >= 0 ELSE value BETWEEN 0 AND 100 END) AS off, review_seconds IS NULL AS loose FROM obs)
SELECT disease, concat_ws(',', CASE WHEN place THEN 'province_not_in_enum' END, CASE WHEN off THEN 'value_out_of_range' END, CASE WHEN loose THEN 'not_grounded' END) AS issues,
 CASE WHEN place OR off THEN 'low' ELSE 'medium' END AS confidence, count(*) AS n FROM c GROUP BY ALL"""
)
def extraction_checks(spark, sf):
    places = F.broadcast(table(spark, sf, "nation").select(F.col("n_name").alias("province"), F.lit(True).alias("known")))  # 25 rows, a fixed dimension
    rows = observations(spark, sf).select("disease", "province", "value", "data_type", "review_seconds").join(places, "province", "left")
    issues = stats.extraction_issues(F.col("value"), F.col("data_type"), F.coalesce("known", F.lit(False)), F.col("review_seconds").isNotNull())
    rows = rows.select("disease", issues.alias("found"))
    return rows.groupBy("disease", F.array_join("found", ",").alias("issues"), stats.extraction_confidence(F.col("found")).alias("confidence")).agg(F.count("*").alias("n"))
