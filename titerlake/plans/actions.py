"""Queries of extracted records, titles and review actions, and the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from titerlake.functions import stats, wording
from titerlake.operators import records, reviews, scan, summary
from titerlake.plans import sql
from titerlake.plans.registry import query
from titerlake.sources.adapters import evidence_sources, observations, table, tasks_for

_AS_FILE = "CASE doc_id % 4 WHEN 0 THEN '2019_2020-03-01 - ' || t || ' (2).PDF' WHEN 1 THEN 'store\\' || t || '_副本' WHEN 2 THEN t || '麻疹_风疹_张三丰' ELSE t END"


@query(
    rf"""WITH s AS (SELECT doc_id, array_to_string(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' ')[1:6], ' ') AS raw FROM documents), n AS (SELECT doc_id, 'x' || trim(raw) || 'y' AS t FROM s WHERE raw IS NOT NULL)
SELECT doc_id AS source_id, {_AS_FILE} AS old_title, CASE doc_id % 4 WHEN 2 THEN t || '麻疹' ELSE t END AS new_title FROM n WHERE doc_id % 4 <> 3"""
)
def title_fixes(spark, sf):
    """Titles that came from file names, and what they are repaired to."""
    words = F.array_join(F.slice(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), 1, 6), " ")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.concat(F.lit("x"), F.trim(words), F.lit("y")).alias("t")).where(F.col("t").isNotNull())
    k = F.col("source_id") % 4
    title = F.when(k == 0, F.concat(F.lit("2019_2020-03-01 - "), "t", F.lit(" (2).PDF"))).when(k == 1, F.concat(F.lit("store\\"), "t", F.lit("_副本"))).when(k == 2, F.concat("t", F.lit("麻疹_风疹_张三丰"))).otherwise(F.col("t"))
    return reviews.title_changes(docs.select("source_id", title.alias("title")))


def _records(spark, sf):
    """Facts of the evidence table as an extraction would write them: text by field name, in four styles."""
    rows = observations(spark, sf).where(F.col("value").isNotNull())
    v, k, rate = F.col("value").cast("string"), F.col("fact_id") % 4, F.col("data_type") == "seroprevalence"
    name = F.when(~rate, F.when(k == 0, "gmt").when(k == 1, "gmc").otherwise("gmc_value")).when(k == 0, "positivity_rate").when(k == 1, "seropositivity").when(k == 2, "after_dose_positivity_measles_IgG").otherwise("positivity_rate")
    text = F.when(rate & (k == 0), F.concat(v, F.lit("%"))).when(rate & (k == 1), F.concat(F.lit(">"), v)).otherwise(v)
    fields = F.map_from_arrays(
        F.array(name, F.lit("disease_name"), F.lit("detection_method"), F.lit("sample_size"), F.lit("estimate_type"), F.lit("sample_year"), F.lit("confidence_interval")),
        F.array(text, F.when(k != 2, F.col("disease")), F.lit("Elisa kit"), F.col("sample_size").cast("string"), F.when(k == 3, "sub").otherwise(F.col("estimate_type")), F.col("collection_year").cast("string"), F.when(rate & (k == 3), "95% CI 1.5%–9.5%")),
    )
    return rows.select("source_id", fields.alias("record"))


@query(
    f"""{sql.OBS}, k AS (SELECT *, fact_id % 4 AS k FROM obs WHERE value IS NOT NULL)
SELECT CASE WHEN k = 2 THEN CASE WHEN data_type = 'seroprevalence' THEN 'measles' END ELSE disease END AS disease_name, 'ELISA' AS detection_method, CASE WHEN k = 3 THEN 'primary' ELSE estimate_type END AS estimate_type, collection_year, data_type,
 CASE WHEN data_type = 'seroprevalence' THEN '%' WHEN k = 0 THEN 'titer' END AS unit, CASE WHEN data_type = 'seroprevalence' AND k = 3 THEN 1.5 END::DOUBLE AS ci_lower, count(*) AS n, sum(sample_size)::BIGINT AS samples, round(min(value), 6) AS least, round(max(value), 6) AS most FROM k GROUP BY ALL"""
)
def record_facts(spark, sf):
    """Records in their standard form as facts, counted."""
    facts = records.facts_of(records.standard_records(_records(spark, sf)))
    keys = ["disease_name", "detection_method", "estimate_type", "collection_year", "data_type", "unit", "ci_lower"]
    return facts.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("sample_size").alias("samples"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query(
    """WITH e AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 5 <> 4), c AS (SELECT vec_id, label, u.i AS i, u.j AS j, abs(embedding[u.i * 4 + u.j + 1]::DOUBLE) AS x FROM e, LATERAL (SELECT a.i, b.j FROM range(2) a(i), range(4) b(j)) u)
SELECT vec_id AS table_id, CASE vec_id % 5 WHEN 0 THEN 'hi' WHEN 1 THEN 'vnt' WHEN 2 THEN 'hi' ELSE 'elisa' END AS assay, 'a' || i AS antigen, 's' || j AS serum, CASE WHEN x < 0.01 THEN 0 WHEN x > 0.3 THEN NULL ELSE floor(x * 1000) END::DOUBLE AS titer FROM c"""
)
def titer_table_cells(spark, sf):
    """Tables of two antigens and four sera from each vector; every fifth is of an unknown assay and is left out."""
    k = (F.col("vec_id") % 5).cast("int")
    x = lambda i, j: F.abs(F.get("embedding", F.lit(4 * i + j)).cast("double"))
    cell = lambda v: F.when(v < 0.01, "<10").when(v > 0.3, "-").otherwise(F.floor(v * 1000).cast("string"))
    titers = F.array(*[F.array(*[cell(x(i, j)) for j in range(4)]) for i in range(2)])
    tables = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("table_id"), F.get(F.array(*map(F.lit, ("HI", " nt ", "hai", "ELISA", "pcr"))), k).alias("assay_type"),
        F.array(F.lit("a0"), F.lit("a1")).alias("antigens"), F.array(*[F.lit(f"s{j}") for j in range(4)]).alias("ref_antisera"), titers.alias("titers"),
    )
    return records.titer_tables(tables)


def _verdicts(spark, sf):
    """Verdicts on every third fact: rejected, then approved; and one for a source that the fact isn't from."""
    facts = observations(spark, sf).groupBy("fact_id", "source_id").agg(F.first("disease").alias("disease"), F.min("review_status").alias("review_status"))
    facts = facts.withColumns({"review_comment": F.lit(None).cast("string"), "reviewer_id": F.lit(None).cast("long"), "reviewed_at": F.lit(None).cast("timestamp")})
    some = facts.where(F.col("fact_id") % 3 == 0).select("fact_id", "source_id")
    at = lambda day: F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")
    first = some.select("fact_id", "source_id", F.lit("rejected").alias("status"), F.lit("first").alias("comment"), F.lit(1).cast("long").alias("reviewer_id"), at(1).alias("reviewed_at"))
    second = some.where(F.col("fact_id") % 2 == 0).select("fact_id", "source_id", F.lit("approved").alias("status"), F.lit("second").alias("comment"), F.lit(2).cast("long").alias("reviewer_id"), at(2).alias("reviewed_at"))
    stray = facts.where(F.col("fact_id") % 3 == 1).select("fact_id", (F.col("source_id") + 1).alias("source_id"), F.lit("approved").alias("status"), F.lit("stray").alias("comment"), F.lit(3).cast("long").alias("reviewer_id"), at(3).alias("reviewed_at"))
    return facts, first.unionByName(second).unionByName(stray)


@query(
    f"""{sql.OBS}, f AS (SELECT fact_id, min(review_status) AS s FROM obs GROUP BY fact_id)
SELECT CASE WHEN fact_id % 6 = 0 THEN 'approved' WHEN fact_id % 3 = 0 THEN 'rejected' ELSE s END AS review_status, CASE WHEN fact_id % 6 = 0 THEN 'second' WHEN fact_id % 3 = 0 THEN 'first' END AS review_comment,
 CASE WHEN fact_id % 6 = 0 THEN 2 WHEN fact_id % 3 = 0 THEN 1 END::BIGINT AS reviewer_id, count(*) AS n FROM f GROUP BY ALL"""
)
def bulk_reviews(spark, sf):
    return reviews.reviewed(*_verdicts(spark, sf), tasks=tasks_for(spark, sf, "lineitem")).groupBy("review_status", "review_comment", "reviewer_id").agg(F.count("*").alias("n"))


@query(
    f"""{sql.OBS}, g AS (SELECT fact_id FROM obs WHERE review_status = 'approved' AND estimate_type = 'primary'), u AS (SELECT 'approved' AS part, * FROM obs WHERE review_status = 'approved' AND estimate_type = 'primary' UNION ALL SELECT 'rest', * FROM obs WHERE fact_id NOT IN (SELECT fact_id FROM g)),
p AS (SELECT part, disease, count(DISTINCT trim(x.p)) AS provinces FROM u, LATERAL (SELECT unnest(string_split(province, ';')) AS p) x GROUP BY ALL)
SELECT part, disease, any_value(p.provinces) AS provinces, count(*) AS points, count(DISTINCT source_id) AS sources, coalesce(sum(sample_size) FILTER (data_type = 'seroprevalence'), 0)::BIGINT AS samples FROM u JOIN p USING (part, disease) GROUP BY part, disease"""
)
def national_split(spark, sf):
    """What is approved and primary, and all the rest, by disease."""
    facts = observations(spark, sf)
    good = facts.where("review_status = 'approved' AND estimate_type = 'primary'")
    both = good.withColumn("part", F.lit("approved")).unionByName(reviews.unapproved(facts, good).withColumn("part", F.lit("rest")))
    provinces = scan.split_provinces(both).groupBy("part", "disease").agg(F.countDistinct("province").alias("provinces"))
    rows = both.groupBy("part", "disease").agg(F.count("*").alias("points"), F.countDistinct("source_id").alias("sources"), F.coalesce(F.sum(F.when(F.col("data_type") == "seroprevalence", F.col("sample_size"))), F.lit(0)).alias("samples"))
    return rows.join(provinces, ["part", "disease"])


@query(
    f"""{sql.OBS}, d AS (SELECT reviewer_id, count(*) AS reviewed, round(avg((review_status = 'approved')::INT), 4) AS pass_rate FROM obs WHERE review_status <> 'pending' GROUP BY reviewer_id)
SELECT d.*, CASE WHEN reviewer_id % 3 = 0 THEN s_name WHEN reviewer_id % 3 = 1 THEN 'user ' || reviewer_id ELSE reviewer_id::VARCHAR END AS reviewer FROM d JOIN supplier ON s_suppkey = reviewer_id"""
)
def reviewer_names(spark, sf):
    """How much each reviewer has done, by name: displayed, of the account, or the id."""
    rows = summary.review_times(observations(spark, sf)).where(F.col("reviewer_id").isNotNull()).select("reviewer_id", "reviewed", "pass_rate")
    k = F.col("s_suppkey") % 3
    users = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("reviewer_id"), F.when(k == 0, F.col("s_name")).otherwise("").alias("display_name"), F.when(k == 1, F.concat(F.lit("user "), F.col("s_suppkey"))).alias("username"))
    return reviews.named_reviewers(rows, users)


@query(
    f"""{sql.OBS} SELECT disease AS old, CASE disease WHEN 'PROMO' THEN 'SALE' ELSE lower(disease) END AS new, count(*) AS n FROM obs WHERE disease IN ('PROMO', 'SMALL') GROUP BY ALL"""
)
def renamed_diseases(spark, sf):
    """What a bulk rename changes."""
    d = F.col("disease")
    return reviews.renamed(observations(spark, sf), "disease", F.when(d == "PROMO", "SALE").when(d == "SMALL", F.lower(d)).otherwise(d))[1]


@query(
    f"""{sql.OBS}, r AS (SELECT DISTINCT fact_id, review_seconds, concat_ws('; ', CASE WHEN province NOT IN (SELECT n_name FROM nation) THEN 'province_not_in_enum' END, CASE WHEN NOT (CASE WHEN data_type = 'gmc' THEN value >= 0 ELSE value BETWEEN 0 AND 100 END) THEN 'value_out_of_range' END, CASE WHEN review_seconds IS NULL THEN 'not_grounded' END) AS issues
 FROM obs WHERE review_status = 'rejected') SELECT fact_id, issues FROM r ORDER BY review_seconds DESC NULLS LAST, fact_id LIMIT 20"""
)
def rejected_lately(spark, sf):
    """The twenty facts rejected last, with what is wrong with them."""
    places = F.broadcast(table(spark, sf, "nation").select(F.col("n_name").alias("province"), F.lit(True).alias("known")))  # 25 rows, a fixed dimension
    rows = observations(spark, sf).where("review_status = 'rejected'").join(places, "province", "left")
    issues = stats.extraction_issues(F.col("value"), F.col("data_type"), F.coalesce("known", F.lit(False)), F.col("review_seconds").isNotNull())
    rows = rows.select("fact_id", "review_status", F.col("review_seconds").alias("reviewed_at"), issues.alias("found")).distinct()
    return reviews.recent_rejected(rows, F.col("found"), 20).select("fact_id", "issues")


@query(
    f"""{sql.OBS} SELECT CASE WHEN p >= 9 THEN 'A' WHEN p >= 6 THEN 'B' WHEN p >= 4 THEN 'C' ELSE 'D' END AS grade, label, count(*) AS n FROM (
SELECT CASE WHEN sample_size >= 1000 THEN 3 WHEN sample_size >= 200 THEN 2 WHEN sample_size >= 50 THEN 1 ELSE 0 END + CASE WHEN age_min % 2 = 0 THEN 2 ELSE 0 END + CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + CASE WHEN review_seconds IS NOT NULL THEN 2 ELSE 0 END
 + CASE WHEN k >= 5 THEN 2 WHEN k >= 2 THEN 1 ELSE 0 END AS p, CASE WHEN age_min % 3 = 0 THEN '<=' || age_max WHEN age_min % 3 = 1 THEN age_min || '+' ELSE age_min || '-' || age_max END AS label
FROM obs JOIN (SELECT source_id, count(*) AS k FROM obs GROUP BY source_id) USING (source_id)) GROUP BY ALL"""
)
def reliability_grades(spark, sf):
    """Grades of reliability by label of age."""
    rows = observations(spark, sf)
    studies = rows.groupBy("source_id").agg(F.count("*").alias("k"))
    rows = rows.join(studies, "source_id")
    grade = wording.reliability(F.col("sample_size"), F.col("age_min") % 2 == 0, F.col("confidence"), F.col("review_seconds").isNotNull(), F.col("k"))
    label = wording.age_label(F.when(F.col("age_min") % 3 != 0, F.col("age_min")), F.when(F.col("age_min") % 3 != 1, F.col("age_max")))
    return rows.groupBy(grade.alias("grade"), label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS source_id, t AS tag FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN [] WHEN doc_id % 3 = 1 THEN ['new', lang] ELSE [source] END) AS t FROM documents) WHERE t IS NOT NULL")
def replaced_tags(spark, sf):
    """The bridge of tags once those of two thirds of the sources are replaced."""
    sources = evidence_sources(spark, sf)
    k = F.col("source_id") % 3
    bridge = sources.select("source_id", F.col("authors").alias("tag")).where(F.col("tag").isNotNull())
    wanted = sources.where(k != 2).select("source_id", F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("new"), F.col("language"), F.lit("new"))).alias("tags"))
    return reviews.retagged(bridge, wanted)
