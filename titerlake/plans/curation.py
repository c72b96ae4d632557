"""Queries of matching, merging and importing, and the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from titerlake.functions import passages
from titerlake.operators import grounding, matching, merging, snapshots
from titerlake.plans import sql
from titerlake.plans.registry import query
from titerlake.sources import references
from titerlake.sources.adapters import catalogued_sources, evidence_sources, observations, table, tasks_for
from titerlake.sources.shared import Tables
from titerlake.streaming import rescoring

# Stored files, cities, parents

_FILES = """files AS (SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN doc_id || '.PDF' WHEN 1 THEN 're/' || doc_id || '.d' WHEN 2 THEN 'lost-' || doc_id || '.pdf' WHEN 3 THEN (doc_id * 2) || '.txt' ELSE 'Ø' || doc_id % 3 END AS name FROM documents),
refs AS (SELECT DISTINCT unnest([file_path, string_split(file_path, '/')[-1]]) AS ref FROM cat WHERE file_path <> '')"""


def _files(spark, sf):
    """Names of stored files: some are paths of sources, some parts of one, some extracts, some lost."""
    i = F.col("doc_id")
    name = F.when(i % 5 == 0, F.concat(i, F.lit(".PDF"))).when(i % 5 == 1, F.concat(F.lit("re/"), i, F.lit(".d"))).when(i % 5 == 2, F.concat(F.lit("lost-"), i, F.lit(".pdf"))).when(i % 5 == 3, F.concat(i * 2, F.lit(".txt")))
    return table(spark, sf, "documents").select(F.coalesce(name, F.concat(F.lit("Ø"), i % 3)).alias("name"))


@query(
    f"""{sql.CATALOGUED}, {_FILES}
SELECT name, CASE WHEN regexp_matches(name, '^[0-9]+[.]txt$') THEN CASE WHEN replace(name, '.txt', '') IN (SELECT doc_id::VARCHAR FROM documents) THEN 'id' END
 WHEN name IN (SELECT ref FROM refs) THEN 'name' WHEN EXISTS (SELECT 1 FROM refs WHERE contains(ref, name)) THEN 'part' END AS reason FROM files"""
)
def orphan_files(spark, sf):
    return matching.orphan_files(_files(spark, sf), catalogued_sources(spark, sf).select("source_id", "file_path"), r"^(\d+)\.txt$")


_CITIES = """, cities AS (SELECT n_name AS province, CASE k WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILD' WHEN 2 THEN 'GREAT FURNITURE' ELSE 'FURNITURE TOWN' END AS city, k::INT AS position, (n_nationkey + k / 10)::DOUBLE AS latitude, (n_nationkey - k / 10)::DOUBLE AS longitude
 FROM nation, range(4) r(k) WHERE n_nationkey % 5 <> 4 OR k = 0), centres AS (SELECT n_name AS province, n_nationkey::DOUBLE AS latitude, -n_nationkey::DOUBLE AS longitude FROM nation)"""


def _city_tables(spark, sf):
    """Places of some cities of each nation (a few rows each), and its centre."""
    nation = table(spark, sf, "nation")
    names = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n).alias("city")) for k, n in enumerate(("AUTOMOBILE", "BUILD", "GREAT FURNITURE", "FURNITURE TOWN"))])
    rows = nation.select(F.col("n_name").alias("province"), "n_nationkey", F.explode(names).alias("c")).where((F.col("n_nationkey") % 5 != 4) | (F.col("c.position") == 0))
    off = F.col("c.position") / 10
    cities = rows.select("province", "c.city", "c.position", (F.col("n_nationkey") + off).alias("latitude"), (F.col("n_nationkey") - off).alias("longitude"))
    return cities, nation.select(F.col("n_name").alias("province"), F.col("n_nationkey").cast("double").alias("latitude"), (-F.col("n_nationkey").cast("double")).alias("longitude"))


@query(
    f"""{sql.OBS}{_CITIES}, f AS (SELECT province, city, count(*) AS n FROM obs GROUP BY ALL),
m AS (SELECT f.*, c.position, c.latitude, c.longitude, CASE WHEN c.city = f.city THEN 0 ELSE 1 END AS r FROM f JOIN cities c ON c.province = f.province AND (contains(f.city, c.city) OR contains(c.city, f.city))),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY province, city ORDER BY r, position) = 1)
SELECT f.province, f.city, f.n, coalesce(b.latitude, e.latitude) AS latitude, coalesce(b.longitude, e.longitude) AS longitude, CASE WHEN b.r = 0 THEN 'exact' WHEN b.r = 1 THEN 'part' WHEN e.latitude IS NOT NULL THEN 'centre' END AS rank
FROM f LEFT JOIN b USING (province, city) LEFT JOIN (SELECT * FROM centres WHERE province IN (SELECT province FROM cities)) e USING (province)"""
)
def city_places(spark, sf):
    counts = observations(spark, sf).groupBy("province", "city").agg(F.count("*").alias("n"))
    return matching.city_places(counts, *_city_tables(spark, sf))


_GROUP = "CASE sample_size % 4 WHEN 0 THEN 'all of ' || province WHEN 1 THEN city || ' sample' WHEN 2 THEN '' ELSE 'elsewhere' END"


@query(
    f"""{sql.OBS}, f AS (SELECT *, {_GROUP} AS parent_group FROM obs),
l AS (SELECT s.fact_id, s.sample_size, min(CASE WHEN contains(s.parent_group, p.province) OR contains(s.parent_group, p.city) THEN p.fact_id END) AS named, CASE WHEN s.parent_group = '' THEN min(p.fact_id) END AS whole
 FROM f s LEFT JOIN f p ON p.estimate_type = 'primary' AND p.source_id = s.source_id AND p.disease = s.disease AND p.data_type = s.data_type WHERE s.estimate_type = 'subgroup' GROUP BY s.fact_id, s.sample_size, s.parent_group)
SELECT coalesce(named, whole) IS NOT NULL AS linked, CASE WHEN named IS NOT NULL THEN 'named' WHEN whole IS NOT NULL THEN 'first' END AS rank, count(*) AS n, sum(coalesce(named, whole) % 1000003)::BIGINT AS parents FROM l GROUP BY ALL"""
)
def parent_groups(spark, sf):
    """How subgroup facts find their parents: counts and a sum over the parents' ids by rank."""
    n = F.col("sample_size") % 4
    group = F.when(n == 0, F.concat(F.lit("all of "), "province")).when(n == 1, F.concat("city", F.lit(" sample"))).when(n == 2, "").otherwise("elsewhere")
    links = matching.link_to_parents(observations(spark, sf).withColumn("parent_group", group), tasks_for(spark, sf, "lineitem"))
    linked = F.col("parent_id").isNotNull()
    return links.groupBy(linked.alias("linked"), "rank").agg(F.count("*").alias("n"), F.sum(F.col("parent_id") % 1000003).alias("parents"))


# Merges

_MERGE = f"""{sql.CATALOGUED}, facts AS (SELECT source_id % 1000 AS source_id, disease, province, collection_year, data_type, review_status FROM obs WHERE source_id % 1000 IN (SELECT source_id FROM sources)),
merges AS (SELECT source_id, source_id - source_id % 10 AS target_id FROM sources WHERE source_id % 10 IN (1, 2)),
k AS (SELECT f.*, coalesce(m.target_id, f.source_id) AS owner, m.target_id IS NOT NULL AS moving FROM facts f LEFT JOIN merges m USING (source_id)),
c AS (SELECT *, bool_or(moving) OVER w AND bool_or(NOT moving) OVER w AND owner IN (SELECT target_id FROM merges) AS conflict FROM k WINDOW w AS (PARTITION BY owner, disease, province, collection_year, data_type)),
a AS (SELECT *, CASE WHEN {{drop}} THEN 'drop' WHEN moving THEN 'move' ELSE 'stay' END AS action FROM c)
SELECT m.target_id, count(*) FILTER (action = 'move') AS moved, count(*) FILTER (action = 'drop') AS dropped, count(*) FILTER (action <> 'drop') AS extracted_count,
 count(*) FILTER (action <> 'drop' AND review_status = 'approved') AS approved_count FROM (SELECT DISTINCT target_id FROM merges) m LEFT JOIN a ON a.owner = m.target_id GROUP BY m.target_id"""


def _merge_inputs(spark, sf):
    """Sources with their facts (of a thousand orders each of the same remainder), and the second and third of every ten merged into the first."""
    sources = catalogued_sources(spark, sf).select("source_id", "title", "keywords", "abstract")
    known = sources.select("source_id")
    facts = observations(spark, sf).withColumn("source_id", F.col("source_id") % 1000).join(known, "source_id", "left_semi")
    i = F.col("source_id")
    return sources, facts, known.where((i % 10).isin(1, 2)).select("source_id", (i - i % 10).alias("target_id"))


def _merge_report(spark, sf, strategy):
    sources, facts, merges = _merge_inputs(spark, sf)
    return merging.merge_sources(sources, facts, merges, {"keywords": "merge", "abstract": "source"}, strategy)[2]


@query(_MERGE.format(drop="false"))
def merge_keep_both(spark, sf):
    return _merge_report(spark, sf, "keep_both")


@query(_MERGE.format(drop="conflict AND moving"))
def merge_prefer_target(spark, sf):
    return _merge_report(spark, sf, "prefer_target")


@query(_MERGE.format(drop="conflict AND NOT moving"))
def merge_prefer_source(spark, sf):
    return _merge_report(spark, sf, "prefer_source")


@query(
    f"""{sql.CATALOGUED}, merges AS (SELECT source_id, source_id - source_id % 10 AS target_id FROM sources WHERE source_id % 10 IN (1, 2)),
g AS (SELECT target_id, arg_min(abstract, m.source_id) FILTER (abstract IS NOT NULL OR true) AS abstract, list(keywords ORDER BY m.source_id) AS given FROM merges m JOIN cat USING (source_id) WHERE EXISTS (SELECT 1 FROM cat t WHERE t.source_id = m.target_id) GROUP BY target_id)
SELECT c.source_id, list_reduce(list_concat([c.keywords], coalesce(given, [])), lambda a, b: list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x)))) AS keywords,
 CASE WHEN given IS NOT NULL THEN (SELECT s.abstract FROM cat s WHERE s.source_id = (SELECT min(m.source_id) FROM merges m WHERE m.target_id = c.source_id)) ELSE c.abstract END AS abstract
FROM cat c LEFT JOIN g ON g.target_id = c.source_id WHERE c.source_id NOT IN (SELECT source_id FROM merges WHERE target_id IN (SELECT source_id FROM cat))"""
)
def merged_sources(spark, sf):
    sources, facts, merges = _merge_inputs(spark, sf)
    merged = merging.merge_sources(sources, facts, merges, {"keywords": "merge", "abstract": "source", "title": "target"}, "keep_both")[0]
    return merged.select("source_id", "keywords", "abstract")


@query(
    f"""{sql.CATALOGUED}, m AS (SELECT s.source_id, t.source_id AS target_id, s.language AS l1, t.language AS l2, s.abstract AS a1, t.abstract AS a2, s.pub_year::VARCHAR AS y1, t.pub_year::VARCHAR AS y2 FROM cat s JOIN cat t ON t.source_id = s.source_id - s.source_id % 10 WHERE s.source_id % 10 IN (1, 2)),
e AS (SELECT source_id, target_id, unnest(['abstract', 'language', 'pub_year']) AS field, unnest([a1, l1, y1]) AS source_value, unnest([a2, l2, y2]) AS target_value FROM m)
SELECT *, source_value IS DISTINCT FROM target_value AS differs FROM e"""
)
def merge_fields(spark, sf):
    """Field by field, what the two sides of each merge say."""
    i = F.col("source_id")
    sources = catalogued_sources(spark, sf)
    merges = sources.where((i % 10).isin(1, 2)).select("source_id", (i - i % 10).alias("target_id"))
    return merging.compared_fields(sources, merges, ["abstract", "language", "pub_year"])


@query(
    f"""{sql.SOURCES}, k AS (SELECT *, {sql.NORMAL_TITLE} AS nt, list_distinct(list_filter(string_split({sql.NORMAL_TITLE}, ' '), lambda x: x <> '')) AS tokens FROM sources),
n AS (SELECT 'file ' || source_id AS name, array_to_string(list_filter(string_split(title, ' '), lambda x, i: i <> 3), ' ') AS title FROM sources WHERE source_id % 2 = 1),
q AS (SELECT name, list_distinct(list_filter(string_split({sql.NORMAL_TITLE}, ' '), lambda x: x <> '')) AS tokens FROM n),
s AS (SELECT q.name, k.source_id, len(list_intersect(q.tokens, k.tokens)) / (len(q.tokens) + len(k.tokens) - len(list_intersect(q.tokens, k.tokens))) AS s FROM q JOIN k ON len(q.tokens) > 0 AND len(k.tokens) > 0)
SELECT name, source_id, round(s, 4) AS similarity FROM s WHERE s >= 0.7 QUALIFY row_number() OVER (PARTITION BY name ORDER BY s DESC, source_id) = 1"""
)
def best_title_match(spark, sf):
    """File titles that lack a word against all sources."""
    sources = Tables(spark, "openings").write(evidence_sources(spark, sf).select("source_id", "title"))  # texts are read once
    short = F.array_join(F.filter(F.split("title", " "), lambda x, i: i != 2), " ")
    files = sources.where(F.col("source_id") % 2 == 1).select(F.concat(F.lit("file "), "source_id").alias("name"), short.alias("title"))
    return merging.best_title_match(files, sources)


@query(
    f"""{sql.SOURCES}, k AS (SELECT {sql.NORMAL_TITLE} AS nt, '10.5/' || source_id AS doi FROM sources WHERE source_id % 3 = 0),
r AS (SELECT CASE WHEN source_id % 11 = 0 THEN '' ELSE title END AS title, CASE WHEN source_id % 4 = 0 THEN '10.5/' || source_id END AS doi FROM sources),
d AS (SELECT *, {sql.NORMAL_TITLE} AS nt FROM r), s AS (SELECT trim(title) = '' OR title IS NULL OR coalesce(doi IN (SELECT doi FROM k), false) OR coalesce(nt <> '' AND nt IN (SELECT nt FROM k WHERE nt <> ''), false) AS skip FROM d)
SELECT count(*) AS total, count(*) FILTER (skip) AS skipped, count(*) FILTER (NOT skip) AS imported FROM s"""
)
def import_preview(spark, sf):
    sources = evidence_sources(spark, sf).select("source_id", "title")
    i = F.col("source_id")
    doi = F.concat(F.lit("10.5/"), i)
    known = sources.where(i % 3 == 0).select("title", doi.alias("doi"), F.lit(None).cast("string").alias("pmid"))
    found = sources.select(F.when(i % 11 == 0, "").otherwise(F.col("title")).alias("title"), F.when(i % 4 == 0, doi).alias("doi"), F.lit("").alias("pmid"))
    return merging.import_preview(known, found)


# Chunks, places, marks

_SIZE, _SLACK = 1500, 300
_ENDS = ", ".join(
    f"CASE WHEN strpos(reverse(part), {m}) > 0 THEN lo + length(part) - strpos(reverse(part), {m}) + 1 END" for m in ("chr(10) || chr(10)", "chr(10)", "'。'", "'；'", "' .'", "' ;'")
)


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
c(doc_id, text, n, a, e) AS (SELECT doc_id, text, n, 0::BIGINT, 0::BIGINT FROM d UNION ALL SELECT doc_id, text, n, e,
 CASE WHEN full_ >= n THEN n ELSE coalesce({_ENDS}, full_) END
 FROM (SELECT *, least(e + {_SIZE}, n) AS full_, e + {_SIZE - _SLACK} AS lo, substr(text, e + {_SIZE - _SLACK} + 1, greatest(least(e + {_SIZE}, n) - (e + {_SIZE - _SLACK}), 0)) AS part FROM c WHERE e < n))
SELECT doc_id, a::INT AS "start", e::INT AS "end", md5(substr(text, a + 1, e - a)) AS chunk_md5 FROM c WHERE e > 0 AND (regexp_matches(substr(text, a + 1, e - a), '[^\\s\\p{{Z}}]') OR n <= {_SIZE})"""
)
def text_chunks(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    spans = docs.select("doc_id", "text", F.explode(passages.chunk_spans(F.col("text"), _SIZE, _SLACK)).alias("s")).where("s.end > 0")
    return spans.select("doc_id", "s.start", "s.end", F.md5(F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))).alias("chunk_md5"))


@query()
def table_chunks(spark, sf):
    """Chunks of texts with a table put into them; no chunk ends inside one."""
    rows = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 30 + 2).cast("int")), lambda i: F.concat(F.lit("| row "), i.cast("string"), F.lit(" | "), F.col("source"), F.lit(" |\n"))), "")
    mixed = F.concat(F.substr("text", F.lit(1), F.lit(1300)), F.lit("\n"), rows, F.substr("text", F.lit(1301), F.length("text")))
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", mixed.alias("text"))
    cut = docs.select("doc_id", "text", passages.table_spans(F.col("text")).alias("tables"), passages.chunk_spans(F.col("text"), _SIZE, _SLACK).alias("chunks"))
    inside = lambda s: F.exists("tables", lambda t: (t["start"] < s["end"]) & (s["end"] < t["end"]))
    return cut.select("doc_id", F.size("tables").alias("n_tables"), F.size("chunks").alias("n_chunks"), F.size(F.filter("chunks", inside)).alias("n_cut"))


_RAW = r"list_filter(list_zip(range(length(text)), string_split(text, '')), lambda x: NOT regexp_matches(x[2], '^[\s\p{Z}]$'))"


@query(
    rf"""WITH s AS (SELECT doc_id AS source_id, text, regexp_replace(text, '[\s\p{{Z}}]+', '', 'g') AS t, {_RAW} AS raw FROM documents WHERE length(text) >= 70),
f AS (SELECT *, instr(t, substr(t, 21, 30)) - 1 AS a FROM s WHERE length(t) >= 50)
SELECT source_id, raw[a + 1][1]::INT AS "start", raw[a + 30][1]::INT + 1 AS "end", md5(substr(text, raw[a + 1][1] + 1, raw[a + 30][1] - raw[a + 1][1] + 1)) AS passage_md5,
 greatest(raw[a + 1][1] - 25, 0)::INT AS window_start, md5(substr(text, greatest(raw[a + 1][1] - 25, 0) + 1, least(raw[a + 30][1] + 1 + 25, length(text)) - greatest(raw[a + 1][1] - 25, 0))) AS window_md5 FROM f"""
)
def raw_passages(spark, sf):
    """Where a passage without its white space stands in the raw text, and what stands around it."""
    docs = evidence_sources(spark, sf).where(F.length("text") >= 70).select("source_id", "text", grounding.squeezed(F.col("text")).alias("t")).where(F.length("t") >= 50)
    span = passages.raw_span(F.col("text"), grounding.located(F.col("t"), F.substr("t", F.lit(21), F.lit(30))))
    rows = docs.select("source_id", "text", span.alias("s")).withColumn("w", passages.window(F.col("text"), F.col("s"), 25))
    return rows.select("source_id", "s.start", "s.end", F.md5(F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))).alias("passage_md5"), F.col("w.start").alias("window_start"), F.md5("w.snippet").alias("window_md5"))


_SAFE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _mark(id_: str, level: str, border: str, part: str) -> str:
    return f"""'<mark id="hl-' || {id_} || '" data-confidence="{level}" style="border-style:{border}">' || {_SAFE.format(part)} || '</mark>'"""


@query(
    f"""WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 40)
SELECT doc_id, md5({_SAFE.format("substr(text, 1, 5)")} || {_mark("doc_id", "high", "solid", "substr(text, 6, 15)")} || {_mark("(doc_id + 1)", "medium", "dashed", "substr(text, 21, 10)")} || {_SAFE.format("substr(text, 31)")}) AS html_md5 FROM d"""
)
def marked_texts(spark, sf):
    """Texts with a mark, one that it overlaps, one inside it, and one beyond the text's end."""
    docs = table(spark, sf, "documents").where(F.length("text") >= 40)

    def mark(start, end, id_, level, grounded):
        return F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"), id_.alias("id"), F.lit(level).cast("string").alias("confidence"), F.lit(grounded).alias("grounded"))

    i = F.col("doc_id")
    marks = F.array(mark(10, 30, i + 1, None, False), mark(5, 20, i, "HIGH", True), mark(7, 12, i + 2, "low", True), mark(10_000_000, 10_000_009, i + 3, "low", True))
    return docs.select("doc_id", F.md5(passages.marked(F.col("text"), marks)).alias("html_md5"))


# Snapshots, scores, bibliographies

_ORDER = ("fact_id", "disease", "value", "sample_size", "age_min", "age_max", "population")


@query(
    f"""{sql.CATALOGUED}, f AS (SELECT *, row_number() OVER (ORDER BY {", ".join(_ORDER)}) AS n FROM obs WHERE review_status = 'approved' AND estimate_type = 'primary')
SELECT 'dp_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS dp_id, disease, province, data_type, round(value, 6) AS value, s.title AS literature_title, s.pub_year AS literature_year
FROM f LEFT JOIN sources s USING (source_id) WHERE n <= 50000"""
)
def dataset_snapshot(spark, sf):
    rows = snapshots.snapshot_facts(observations(spark, sf), evidence_sources(spark, sf), order=_ORDER)
    return rows.select("dp_id", "disease", "province", "data_type", F.round("value", 6).alias("value"), "literature_title", "literature_year")


@query(
    f"""{sql.OBS}, r AS (SELECT substr(sha256(fact_id::VARCHAR), 1, 3) AS part, fact_id::VARCHAR AS id, sha256(fact_id || ',' || review_status || ',' || floor(value * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT) AS d FROM obs),
p AS (SELECT part, sha256(string_agg(d, '' ORDER BY id, d)) AS d, count(*) AS n FROM r GROUP BY part)
SELECT sum(n)::BIGINT AS n, substr(sha256(string_agg(part || d, '' ORDER BY part)), 1, 16) AS data_hash FROM p"""
)
def data_hash(spark, sf):
    return snapshots.data_hash(observations(spark, sf))


@query(
    f"""{sql.OBS} SELECT DISTINCT fact_id FROM (SELECT DISTINCT fact_id, review_seconds, collection_year FROM obs WHERE review_status = 'approved' AND fact_id % 3 <> 0 ORDER BY review_seconds NULLS FIRST, fact_id, collection_year LIMIT 500)"""
)
def scores_waiting(spark, sf):
    """The first batch to score: approved facts without a score, those reviewed fastest first."""
    rows = observations(spark, sf).where("review_status = 'approved'").select("fact_id", "review_seconds", "collection_year", "review_status").distinct()
    rows = rows.select("fact_id", "review_status", "collection_year", F.when(F.col("fact_id") % 3 == 0, 50).alias("quality_score"), F.col("review_seconds").alias("updated_at"))
    return rescoring.waiting_for_score(rows).select("fact_id").distinct()


def _bibliographies(spark, sf):
    """A file of two equal records for every source, in one of five formats."""
    docs = evidence_sources(spark, sf)
    title, year, kind = F.trim(F.regexp_replace("title", r"[^A-Za-z ]", "")), F.col("pub_year").cast("string"), F.col("source_id") % 5

    def lines(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    who = F.col("authors")
    ris = lines("TY  - JOUR\nTI  - ", title, "\n  and more\nAU  - ", who, "\nAU  - Second, B\nPY  - ", year, "/01\nER  - \n")
    enw = lines("%0 Journal Article\n%T ", title, "\nand more\n%A ", who, "\n%A Second, B\n%D ", year, "\n")
    wos = lines("PT J\nAU ", who, "\n   Second, B\nTI ", title, "\n   and more\nPY ", year, "\nER\n")
    pubmed = lines("PMID- 5\nTI  - ", title, "\n      and more\nFAU - ", who, "\nFAU - Second, B\nDP  - ", year, " Mar\n")
    duxiu = lines("1. [x]\n题 名：", title, " and more\n作 者：", who, "; Second, B\n出 处：J; ", year, ", 2\n")
    text = F.when(kind == 0, ris).when(kind == 1, enw).when(kind == 2, wos).when(kind == 3, pubmed).otherwise(duxiu)
    return docs.where(F.length(title) > 0).select(F.col("source_id").cast("string").alias("file"), F.repeat(text, 2).alias("text"))


@query(
    rf"""{sql.SOURCES}, t AS (SELECT source_id, authors, pub_year, trim(regexp_replace(title, '[^A-Za-z ]', '', 'g')) AS t FROM sources)
SELECT source_id::VARCHAR AS file, 2 AS n, CASE WHEN source_id % 5 = 4 THEN regexp_replace(t, '\s+', ' ', 'g') ELSE t END || ' and more' AS title, authors || '; Second, B' AS authors, pub_year::VARCHAR AS year,
 ['ris', 'enw', 'wos', 'pubmed_ris', 'duxiu'][source_id % 5 + 1] AS format FROM t WHERE t <> ''"""
)
def bibliography_files(spark, sf):
    found = references.parse_references(_bibliographies(spark, sf))
    return found.groupBy("file", "format", "title", "authors", "year").agg(F.count("*").alias("n"))
