"""Queries on texts, passages, copies and intervals, and the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from titerlake.functions import wording
from titerlake.operators import duplicates, grounding, scan, spans, summary
from titerlake.plans import sql
from titerlake.plans.registry import query
from titerlake.sources.adapters import catalogued_sources, evidence_sources, observations, table

_FLAT = r"regexp_replace(coalesce({}, ''), '[\s\p{{Z}}]+', '', 'g')"
_TRIES = ", ".join(f"CASE WHEN {skip} <= n - greatest(4, n - {cut}) THEN instr(t, substr(p, {skip + 1}, greatest(4, n - {cut}))) ELSE 0 END" for cut, skip in grounding.TRIMS)


def _cited(spark, sf):
    """Each text with a passage said to come from it: as it is, with foreign edges, reversed, or none."""
    part = F.substr("text", F.lit(11), F.lit(40))
    kind = F.col("source_id") % 4
    cited = F.when(kind == 0, part).when(kind == 1, F.concat(F.lit("##"), part, F.lit("##"))).when(kind == 2, F.reverse(part))
    return evidence_sources(spark, sf).select("source_id", "text", cited.alias("passage"))


@query(
    rf"""WITH c AS (SELECT doc_id AS source_id, text, CASE doc_id % 4 WHEN 0 THEN substr(text, 11, 40) WHEN 1 THEN '##' || substr(text, 11, 40) || '##' WHEN 2 THEN reverse(substr(text, 11, 40)) END AS passage FROM documents),
s AS (SELECT source_id, {_FLAT.format("text")} AS t, {_FLAT.format("passage")} AS p, length(p) AS n FROM c),
f AS (SELECT *, CASE WHEN n >= 4 THEN list_filter([{_TRIES}], lambda x: x > 0)[1] - 1 END AS a FROM s)
SELECT source_id, a::INT AS "start", CASE WHEN a IS NOT NULL THEN least(a + n, length(t)) END::INT AS "end" FROM f"""
)
def passage_locations(spark, sf):
    rows = _cited(spark, sf)
    span = grounding.located(grounding.squeezed(F.col("text")), grounding.squeezed(F.col("passage")))
    return rows.select("source_id", span.alias("s")).select("source_id", "s.start", "s.end")


@query()
def passage_grounding(spark, sf):
    """Passages as they are, with a letter changed, or foreign; every fifth source states a number that its text lacks."""
    i = F.col("source_id")
    part = F.substr("text", F.lit(31), F.lit(60))
    passage = F.when(i % 3 == 0, part).when(i % 3 == 1, F.translate(part, "eo", "%%")).otherwise(F.lit("quite another passage, 0123456789"))
    # a number the text lacks, or one written in it: 0.0005 is only found without an exponent
    number = F.when(i % 5 == 0, F.lit(987654321.25)).when(i % 5 == 1, F.lit(0.0005))
    rows = evidence_sources(spark, sf).select("source_id", F.concat(F.col("text"), F.when(i % 5 == 1, " at a rate of 0.0005 a year").otherwise("")).alias("text"), "title", passage.alias("passage"), number.alias("number"))
    found = grounding.ground(rows, "text", "passage", F.split("title", " "), F.array("number"))
    return found.select("source_id", "method", "start", "end", "grounded")


@query(
    f"""WITH RECURSIVE sources AS (SELECT doc_id AS source_id, array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[1:8], ' ') AS title, source AS authors, text FROM documents),
t AS (SELECT source_id AS id, text, {sql.NORMAL_TITLE} AS nt, coalesce({sql.SURNAME}, '') AS who, list_distinct(list_filter(string_split({sql.NORMAL_TITLE}, ' '), lambda x: x <> '')) AS tokens,
 CASE WHEN source_id % 20 = 0 THEN '10.1/x' || (source_id // 40) END AS doi FROM sources),
e AS (SELECT min(id) OVER (PARTITION BY doi) AS a, id AS b, 'doi' AS reason FROM t WHERE doi IS NOT NULL
 UNION ALL SELECT min(id) OVER (PARTITION BY text), id, 'file_hash' FROM t WHERE text IS NOT NULL
 UNION ALL SELECT min(id) OVER (PARTITION BY nt), id, 'title' FROM t WHERE nt <> ''
 UNION ALL SELECT x.id, y.id, 'title+authors' FROM t x JOIN t y ON x.who = y.who AND x.id < y.id AND x.nt <> y.nt WHERE len(list_intersect(x.tokens, y.tokens)) / (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens))) >= 0.7),
l AS (SELECT * FROM e WHERE a <> b), both_ AS (SELECT DISTINCT a, b FROM l UNION SELECT b, a FROM l),
reach(s, v) AS (SELECT a, a FROM both_ UNION SELECT r.s, o.b FROM reach r JOIN both_ o ON r.v = o.a),
root AS (SELECT s AS id, min(v) AS root FROM reach GROUP BY s),
why AS (SELECT root, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM l JOIN root ON l.a = root.id GROUP BY root)
SELECT root AS group_id, count(*) AS n_sources, min((id % 400) * 1000000000000 + id) % 1000000000000 AS representative_id, any_value(reasons) AS reasons FROM root JOIN why USING (root) GROUP BY root"""
)
def duplicate_components(spark, sf):
    i = F.col("source_id")
    doi = F.when(i % 20 == 0, F.concat(F.when(i % 40 == 0, "10.1/x").otherwise("10.1/X"), F.floor(i / 40).cast("string")))
    sources = catalogued_sources(spark, sf).select("source_id", "title", "authors", "created_at", F.sha2("text", 256).alias("file_hash"), doi.alias("doi"))
    return duplicates.duplicate_components(sources)


_AGES = f"{sql.OBS}, d AS (SELECT DISTINCT disease, city, age_min AS s, age_max AS e FROM obs), r AS (SELECT *, max(e) OVER (PARTITION BY disease, city ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d)"


def _ages(spark, sf):
    return observations(spark, sf).select("disease", "city", F.col("age_min").alias("start"), F.col("age_max").alias("end"))


@query(
    f"""{_AGES}, g AS (SELECT *, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY disease, city ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT disease, city, min(s) AS "start", max(e) AS "end", count(*) AS n_spans FROM g GROUP BY disease, city, g"""
)
def merged_age_spans(spark, sf):
    return spans.merged(_ages(spark, sf), ["disease", "city"])


@query(f"""{_AGES} SELECT disease, city, greatest(s, coalesce(reach, s)) AS "start", e AS "end" FROM r WHERE greatest(s, coalesce(reach, s)) < e""")
def visible_age_spans(spark, sf):
    return spans.visible(_ages(spark, sf), ["disease", "city"])


@query(
    r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 400) AS head, length(regexp_extract(substr(text, 1, 400), '(?s)^(.*)\n', 1)) AS l FROM documents),
c AS (SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN contains(head, chr(10)) AND l > 280 THEN substr(head, 1, l) ELSE head END AS t FROM h) SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM c"""
)
def truncated_texts(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", wording.truncated(F.col("text"), 400).alias("t"))
    return cut.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(
    r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 50) || chr(10) || 'references' || chr(10) || '[1] ' || lang || chr(10) || 'no number' || chr(10) || ' 2. ' || source ELSE text END AS t FROM documents),
r AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_extract(t, '(?is)(?:参考文献|References)\s*\n(.*)', 1), chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[\[(]?\d+[\]).]')) AS refs FROM d)
SELECT doc_id, len(refs) AS n, array_to_string(refs, '|') AS refs FROM r WHERE len(refs) > 0"""
)
def reference_lists(spark, sf):
    docs = table(spark, sf, "documents")
    listed = F.concat(F.substr("text", F.lit(1), F.lit(50)), F.lit("\nreferences\n[1] "), "lang", F.lit("\nno number\n 2. "), "source")
    refs = docs.select("doc_id", wording.reference_list(F.when(F.col("doc_id") % 2 == 0, listed).otherwise(F.col("text"))).alias("r")).where(F.size("r") > 0)
    return refs.select("doc_id", F.size("r").cast("long").alias("n"), F.array_join("r", "|").alias("refs"))


@query(
    r"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, contains(lower(line), 'an')::INT + contains(lower(line), 'er')::INT + contains(lower(line), 'o')::INT + (i < 3)::INT AS s FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM s)
SELECT doc_id, md5(CASE WHEN length(any_value(text)) <= 300 THEN any_value(text) ELSE string_agg(line, chr(10) ORDER BY i) FILTER (k <= greatest(4, n * 2 // 3)) END) AS text_md5 FROM k GROUP BY doc_id"""
)
def focused_texts(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.md5(wording.focused(F.col("text"), ["an", "ER", "o"], 300, 4, 3)).alias("text_md5"))


@query(
    """WITH u AS (SELECT lower(p_brand) AS model, count(*) AS calls, sum(p_partkey)::BIGINT AS inward, sum(p_size)::BIGINT AS outward FROM part GROUP BY ALL)
SELECT model, calls, CASE WHEN contains(model, 'brand#1') THEN round(inward*0.15 + outward*0.6)/1e6 WHEN contains(model, '#2') THEN round(inward*2.5 + outward*10.0)/1e6 ELSE 0 END AS cost FROM u"""
)
def usage_cost(spark, sf):
    used = table(spark, sf, "part").groupBy(F.lower("p_brand").alias("model")).agg(F.count("*").alias("calls"), F.sum("p_partkey").alias("inward"), F.sum("p_size").alias("outward"))
    price = wording.listed_price(F.col("model"), {"brand#1": (0.15, 0.6), "#2": (2.5, 10.0)})
    cost = F.round(F.col("inward") * price["inward"] + F.col("outward") * price["outward"], 0).cast("double") / 1e6
    return used.select("model", "calls", F.coalesce(cost, F.lit(0.0)).alias("cost"))


@query(
    f"""{sql.SERO}, y AS (SELECT disease, collection_year, sum(value * n) / sum(n) AS rate FROM sero WHERE p IS NOT NULL AND n > 0 GROUP BY ALL),
s AS (SELECT *, rate - lag(rate) OVER (PARTITION BY disease ORDER BY collection_year) AS step FROM y)
SELECT disease, min(collection_year) AS first_year, max(collection_year) AS last_year, round(arg_max(rate, collection_year), 4) AS last_rate, coalesce(bool_or(step < -0.5), false) AS falls FROM s GROUP BY disease"""
)
def rate_steps(spark, sf):
    rows = summary.sero(scan.split_provinces(scan.base_scan(observations(spark, sf)))).where(F.col("p").isNotNull() & (F.col("n") > 0))
    years = rows.groupBy("disease", "collection_year").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("rate"))
    steps = years.withColumn("step", F.col("rate") - F.lag("rate").over(W.partitionBy("disease").orderBy("collection_year")))
    return steps.groupBy("disease").agg(
        F.min("collection_year").alias("first_year"), F.max("collection_year").alias("last_year"), F.round(F.max_by("rate", "collection_year"), 4).alias("last_rate"),
        F.coalesce(F.bool_or(F.col("step") < -0.5), F.lit(False)).alias("falls"),
    )


@query(
    f"""{sql.OBS} SELECT disease, province, collection_year, round(coalesce(sum(value * sample_size) FILTER (data_type = 'seroprevalence') / sum(sample_size) FILTER (data_type = 'seroprevalence'), 0), 2) AS rate,
 round(coalesce(avg(value) FILTER (data_type = 'gmc'), 0), 2) AS mean_concentration FROM obs WHERE review_status = 'approved' GROUP BY GROUPING SETS ((disease), (province), (collection_year))"""
)
def report_context(spark, sf):
    rows = observations(spark, sf).where(F.col("review_status") == "approved")
    value, n, rate = F.col("value"), F.col("sample_size"), F.col("data_type") == "seroprevalence"
    sets = rows.groupingSets([[F.col(c)] for c in ("disease", "province", "collection_year")], F.col("disease"), F.col("province"), F.col("collection_year"))
    return sets.agg(
        F.round(F.coalesce(F.try_divide(F.sum(F.when(rate, value * n)), F.sum(F.when(rate, n))), F.lit(0.0)), 2).alias("rate"),
        F.round(F.coalesce(F.avg(F.when(F.col("data_type") == "gmc", value)), F.lit(0.0)), 2).alias("mean_concentration"),
    )
