"""Common parts of the DuckDB SQL: the evidence tables and the aggregates that many queries share."""

from __future__ import annotations

OBS = """WITH obs AS (
SELECT l_orderkey AS source_id, p_type AS disease, CASE WHEN l_linenumber = 7 THEN n_name || '; ' || r_name ELSE n_name END AS province, r_name AS region,
 c_mktsegment AS city, CASE WHEN l_returnflag = 'R' THEN 'gmc' ELSE 'seroprevalence' END AS data_type,
 CASE WHEN l_returnflag = 'R' THEN l_extendedprice / l_quantity ELSE round(l_discount * 1000) END AS value, floor(l_quantity)::INT AS sample_size,
 p_size - 1 AS age_min, p_size + l_linenumber AS age_max, year(o_orderdate) AS collection_year,
 CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS review_status,
 CASE WHEN l_linestatus = 'O' THEN 'primary' ELSE 'subgroup' END AS estimate_type, p_brand AS assay,
 CASE WHEN l_linenumber <= 2 THEN 'high' WHEN l_linenumber <= 4 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'A' WHEN o_orderpriority[1] = '3' THEN 'B' ELSE 'C' END AS quality_grade,
 CASE WHEN l_shipdate > o_orderdate THEN (epoch(l_shipdate) - epoch(o_orderdate))::BIGINT END AS review_seconds, l_suppkey AS reviewer_id,
 CASE WHEN l_tax < 0.03 THEN 'vaccinated' WHEN l_tax < 0.06 THEN 'unvaccinated' ELSE 'general' END AS population,
 ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000) * 10000 + l_suppkey % 10000 AS fact_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
SCAN = OBS + ", scan AS (SELECT * FROM obs WHERE review_status = 'approved' AND estimate_type = 'primary' AND quality_grade IN ('A', 'B'))"
EACH = SCAN + ", each_ AS (SELECT scan.* EXCLUDE (province), trim(u.name) AS province FROM scan, LATERAL (SELECT unnest(string_split(scan.province, ';')) AS name) u WHERE trim(u.name) <> '')"
SERO = EACH + (
    ", sero AS (SELECT * EXCLUDE (p0), CASE WHEN p0 BETWEEN 0 AND 1 THEN p0 END AS p FROM "
    "(SELECT *, CASE WHEN value > 1 THEN value / 100 ELSE value END AS p0, sample_size::DOUBLE AS n FROM each_ WHERE data_type = 'seroprevalence'))"
)

_N = "sum(n) FILTER (p IS NOT NULL)"
_R, _E = f"(sum(p * n) / {_N})", f"(sqrt(sum(n * p * (1 - p))) / {_N})"
RATE = (
    f"round({_R} * 100, 2) AS rate, round(greatest({_R} - 1.96 * {_E}, 0) * 100, 2) AS ci_lower, "
    f"round(least({_R} + 1.96 * {_E}, 1) * 100, 2) AS ci_upper, ({_N})::BIGINT AS total_sample, count(*) AS n_points"
)
_V = "round(least(greatest(CASE WHEN value > 0 AND value <= 1 THEN value * 100 ELSE value END, 0), 100), 4)"
_OK = "(data_type = 'seroprevalence' AND sample_size > 0)"
MAP = (
    "count(*) AS n_points, count(DISTINCT source_id) AS n_sources, sum(sample_size)::BIGINT AS samples, "
    f"round(sum({_V} * sample_size) FILTER {_OK} / sum(sample_size) FILTER {_OK}, 2) AS rate"
)
_M = "(sum(sample_size * ln(value)) / sum(sample_size))"
_SE = f"sqrt(CASE WHEN count(*) > 1 THEN greatest(count(*) * (sum(sample_size * ln(value) * ln(value)) - sum(sample_size * ln(value)) * {_M}) / nullif(sum(sample_size) * (count(*) - 1), 0), 0) END / count(*))"
GMC = f"round(exp({_M}), 4) AS gmc, round(exp({_M} - 1.96 * {_SE}), 4) AS ci_lower, round(exp({_M} + 1.96 * {_SE}), 4) AS ci_upper, count(*) AS n_values"
MID = "((age_min + age_max) / 2)"
BAND = f"CASE WHEN {MID} < 1 THEN '<1' WHEN {MID} < 5 THEN '1-4' WHEN {MID} < 15 THEN '5-14' WHEN {MID} < 60 THEN '15-59' ELSE '60+' END"
FOI = EACH + (
    f""", foi AS (SELECT disease, {BAND} AS age_band, province, round(sum(value * sample_size) / sum(sample_size), 2) AS rate,
 round(sum(f * sample_size) / sum(sample_size) FILTER (f IS NOT NULL), 6) AS foi, sum(sample_size)::BIGINT AS samples
 FROM (SELECT *, CASE WHEN {MID} <= 0 THEN NULL WHEN value <= 0 THEN 0 ELSE -ln(1 - least(value, 99.99) / 100) / {MID} END AS f FROM each_ WHERE data_type = 'seroprevalence')
 GROUP BY ALL)"""
)
SOURCES = r"""WITH sources AS (SELECT doc_id AS source_id, array_to_string(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')[1:8], ' ') AS title,
 source AS authors, lang AS language, 1990 + doc_id % 30 AS pub_year, n_chars, text FROM documents)"""
NORMAL_TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[-_–—]+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
SURNAME = r"lower(regexp_extract(trim(regexp_extract(authors, '^[^;,]*')), '[^\s]*$'))"
PLACES = SERO + (
    f""", v AS (SELECT province AS place, round({_R} * 100, 2) AS x FROM (SELECT scan.*, CASE WHEN value > 1 THEN value / 100 ELSE value END AS p, sample_size::DOUBLE AS n FROM scan WHERE data_type = 'seroprevalence')
 WHERE province IN (SELECT n_name FROM nation) GROUP BY province),
edges AS (SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name)"""
)
TITERS = """WITH cells AS (SELECT label AS antigen, (u.i - 1)::INT AS serum, 10 + 1000 * abs(avg(embedding[u.i]::DOUBLE)) AS titer FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) u GROUP BY ALL),
t AS (SELECT antigen, serum, log2(titer / 10) AS lt, max(log2(titer / 10)) OVER (PARTITION BY serum) AS top FROM cells)"""


def inverse_variance(key: str) -> str:
    return f"""{SERO}, a AS (SELECT {key}, p, n, CASE WHEN p IN (0, 1) THEN (p*n + 0.5)/(n + 1) ELSE p END AS p2, CASE WHEN p IN (0, 1) THEN n + 1 ELSE n END AS n2 FROM sero WHERE p IS NOT NULL AND n > 0),
s AS (SELECT {key}, p, p2*(1 - p2)/n2 AS v FROM a WHERE p2*(1 - p2) > 0),
f AS (SELECT {key}, count(*) AS k, sum(1/v) AS sw, sum(1/v/v) AS sww, sum(p/v) AS swp, sum(p*p/v) AS swpp FROM s GROUP BY {key}),
g AS (SELECT *, greatest(swpp - swp*swp/sw, 0) AS q FROM f),
h AS (SELECT *, CASE WHEN q > k - 1 THEN (q - (k - 1))/q*100 ELSE 0 END AS i2, greatest(coalesce((q - (k - 1))/nullif(sw - sww/sw, 0), 0), 0) AS tau2 FROM g),
r AS (SELECT {key}, sum(p/(v + tau2))/sum(1/(v + tau2)) AS rnd FROM s JOIN h USING ({key}) GROUP BY {key})
SELECT {key}, k, round(swp/sw, 6) AS fixed, round(rnd, 6) AS random, round(q, 4) AS q, round(i2, 2) AS i2, round(tau2, 6) AS tau2,
CASE WHEN i2 < 25 THEN 'low' WHEN i2 < 50 THEN 'moderate' ELSE 'high' END AS heterogeneity FROM h JOIN r USING ({key})"""


def _back(t: str) -> str:
    """Percent of a double arcsine ``t``, by the closed form."""
    root = f"sqrt(greatest(1 - (sin({t}) + (sin({t}) - 1/sin({t}))/nh)^2, 0))"
    return f"round(CASE WHEN {t} <= asin(sqrt(1/(nh + 1))) THEN 0 WHEN {t} >= asin(sqrt(nh/(nh + 1))) + pi()/2 THEN 1 ELSE 0.5*(1 - sign(cos({t}))*{root}) END * 100, 2)"


def double_arcsine(key: str) -> str:
    chi = "greatest(k - 1, 1)"
    return f"""{SERO}, s AS (SELECT {key}, n, n + 0.5 AS w, asin(sqrt(p*n/(n + 1))) + asin(sqrt((p*n + 1)/(n + 1))) AS t FROM sero WHERE p IS NOT NULL AND n > 0),
f AS (SELECT {key}, count(*) AS k, sum(w) AS sw, sum(w*w) AS sww, sum(w*t)/sum(w) AS fixed, count(*)/sum(1/n) AS nh FROM s GROUP BY {key}),
q AS (SELECT {key}, sum(w*(t - fixed)^2) AS q FROM s JOIN f USING ({key}) GROUP BY {key}),
g AS (SELECT f.*, q.q, CASE WHEN q > k - 1 THEN (q - (k - 1))/q*100 ELSE 0 END AS i2, greatest(coalesce((q - (k - 1))/nullif(sw - sww/sw, 0), 0), 0) AS tau2 FROM f JOIN q USING ({key})),
r AS (SELECT {key}, sum(1/(1/w + tau2)) AS srw, sum(t/(1/w + tau2)) AS srwt FROM s JOIN g USING ({key}) GROUP BY {key}),
u AS (SELECT *, k > 1 AND (i2 > 50 OR q > {chi}*(1 - 2/(9*{chi}) + 1.2815515655446004*sqrt(2/(9*{chi})))^3) AS apart FROM g JOIN r USING ({key})),
z AS (SELECT *, CASE WHEN apart THEN srwt/srw ELSE fixed END AS m, CASE WHEN apart THEN 1/sqrt(srw) ELSE 1/sqrt(sw) END AS se FROM u),
b AS (SELECT *, m - 1.96*se AS lo, m + 1.96*se AS hi FROM z)
SELECT {key}, k, round(q, 4) AS q, round(i2, 2) AS i2, round(tau2, 6) AS tau2, CASE WHEN apart THEN 'random' ELSE 'fixed' END AS model,
{_back("m")} AS rate, {_back("lo")} AS ci_lower, {_back("hi")} AS ci_upper FROM b"""


CATALOGUED = OBS + """, sources AS (SELECT doc_id AS source_id, array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[1:8], ' ') AS title, source AS authors,
 lang AS language, 1990 + doc_id % 30 AS pub_year, text FROM documents),
counts AS (SELECT source_id, count(*) AS extracted, count(*) FILTER (review_status = 'approved') AS approved FROM obs GROUP BY source_id),
cat0 AS (SELECT s.*, CASE WHEN s.source_id % 7 = 0 THEN NULL WHEN s.source_id % 11 = 0 THEN 'https://host/' || s.source_id
   ELSE 'store/' || s.source_id || ['.PDF', '.docx', '.html', '.htm', '.txt'][s.source_id % 5 + 1] END AS file_path,
 CASE s.source_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE substr(text, 1, 80) END AS abstract, [language, 'year ' || pub_year] AS keywords,
 DATE '2020-01-01' + (s.source_id % 400)::INT AS created_at, CASE WHEN s.source_id % 13 = 0 THEN DATE '2021-06-01' + (s.source_id % 60)::INT END AS deleted_at,
 coalesce(extracted, 0) AS extracted, coalesce(approved, 0) AS approved FROM sources s LEFT JOIN counts USING (source_id)),
cat AS (SELECT *, CASE WHEN lower(file_path) LIKE '%.pdf' THEN 'PDF' WHEN lower(file_path) LIKE '%.docx' THEN 'DOCX' WHEN lower(file_path) LIKE '%.txt' THEN 'TXT'
 WHEN lower(file_path) LIKE '%.htm' THEN 'HTML' WHEN file_path LIKE 'https://%' THEN 'URL' END AS form,
 CASE WHEN extracted = 0 THEN 'none' WHEN approved = 0 THEN 'pending' WHEN approved < extracted THEN 'partial' ELSE 'approved' END AS state FROM cat0)"""
