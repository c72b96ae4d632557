"""Queries of permutation tests, curves by age, catalytic models and antigenic maps, and the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from titerlake.functions import stats
from titerlake.operators import antigenic, catalytic, curves, permutation, scan, spatial, summary
from titerlake.plans import sql
from titerlake.plans.registry import query
from titerlake.sources.adapters import observations, table

_R = "sum(p * n) / sum(n) FILTER (p IS NOT NULL)"
_YEARS = f"""{sql.SERO}, v AS (SELECT collection_year AS g, province AS place, round({_R} * 100, 2) AS x FROM (SELECT scan.*, CASE WHEN value > 1 THEN value / 100 ELSE value END AS p, sample_size::DOUBLE AS n FROM scan WHERE data_type = 'seroprevalence')
 WHERE province IN (SELECT n_name FROM nation) GROUP BY ALL),
edges AS (SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name),
s AS (SELECT g, place, x, x - avg(x) OVER (PARTITION BY g) AS z, row_number() OVER (PARTITION BY g ORDER BY place) AS slot, count(*) OVER (PARTITION BY g) AS n FROM v WHERE x IS NOT NULL)"""


def _yearly_rates(spark, sf):
    """Rates of nations by year, and edges between nations of a region (25 rows)."""
    nation = table(spark, sf, "nation")
    a, b = (nation.select(F.col("n_name").alias(x), "n_regionkey") for x in ("src", "dst"))
    edges = a.join(b, "n_regionkey").where(F.col("src") != F.col("dst")).select("src", "dst")
    rates = summary.rate_by(scan.base_scan(observations(spark, sf)), "collection_year", "province").join(nation.select(F.col("n_name").alias("province")), "province", "left_semi")
    return rates.select("collection_year", F.col("province").alias("place"), F.col("rate").alias("x")), edges


@query(
    f"""{_YEARS}, p AS (SELECT s.g, s.place, k, CASE WHEN k = 0 THEN slot ELSE row_number() OVER (PARTITION BY s.g, k ORDER BY md5('7|' || k || '|' || place), place) END AS slot FROM s, range(0, 1000) r(k)),
y AS (SELECT p.g, p.k, p.place, s.z, s.n FROM p JOIN s ON p.g = s.g AND p.slot = s.slot),
w AS (SELECT a.g, src, dst, 1 / count(*) OVER (PARTITION BY a.g, src) AS w FROM edges JOIN s a ON a.place = src JOIN s b ON b.place = dst AND b.g = a.g),
c AS (SELECT w.g, a.k, sum(w * a.z * b.z) AS c, sum(w) AS s0 FROM w JOIN y a ON a.g = w.g AND a.place = src JOIN y b ON b.g = w.g AND b.place = dst AND b.k = a.k GROUP BY ALL),
zz AS (SELECT g, sum(z * z) AS zz, any_value(n) AS n FROM s GROUP BY g),
i AS (SELECT c.g, k, n, round(n * c / nullif(s0 * zz, 0), 9) AS i FROM c JOIN zz ON c.g = zz.g),
o AS (SELECT i.g, i.n, j.i AS i, count(*) FILTER (i.k > 0 AND i.i >= j.i) AS above, avg(i.i) FILTER (i.k > 0) AS mean, stddev_pop(i.i) FILTER (i.k > 0) AS sd FROM i JOIN i j ON i.g = j.g AND j.k = 0 GROUP BY ALL),
q AS (SELECT *, (least(above, 999 - above) + 1) / 1000 AS p FROM o)
SELECT g AS collection_year, n, CASE WHEN n >= 8 THEN round(i, 6) END AS morans_i, CASE WHEN n >= 8 THEN round(p, 6) END AS p_sim, CASE WHEN n >= 8 THEN round((i - mean)/sd, 4) END AS z_sim,
 CASE WHEN n >= 8 THEN CASE WHEN p >= 0.05 THEN 'random' WHEN i > 0 THEN 'clustered' ELSE 'dispersed' END END AS pattern FROM q"""
)
def moran_permutation(spark, sf):
    return permutation.moran_test(*_yearly_rates(spark, sf), ["collection_year"])


@query(
    f"""{_YEARS}, e AS (SELECT s.g, s.place, count(d.place) AS degree, s.x + coalesce(sum(d.x), 0) AS observed FROM s LEFT JOIN edges ON src = s.place LEFT JOIN s d ON d.g = s.g AND d.place = dst GROUP BY s.g, s.place, s.x),
r AS (SELECT s.g, s.place, s.x, s.n, degree, observed, k, row_number() OVER w AS rank, sum(s.x) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM s JOIN e ON e.g = s.g AND e.place = s.place, range(1, 1000) t(k)
 WINDOW w AS (PARTITION BY s.g, k ORDER BY md5('7|' || k || '|' || s.place), s.place)),
t AS (SELECT r.*, r.x + coalesce(b.running, 0) - CASE WHEN r.rank <= r.degree THEN r.x ELSE 0 END AS sim FROM r LEFT JOIN r b ON b.g = r.g AND b.k = r.k AND b.rank = r.degree + (r.rank <= r.degree)::INT),
a AS (SELECT g, place, any_value(n) AS n, any_value(degree) AS degree, count(*) FILTER (round(sim, 9) >= round(observed, 9)) AS above FROM t GROUP BY g, place)
SELECT g AS collection_year, place, degree, CASE WHEN n >= 8 THEN round((least(above, 999 - above) + 1) / 1000, 6) END AS p_sim FROM a"""
)
def gi_star_permutation(spark, sf):
    return permutation.gi_star_test(*_yearly_rates(spark, sf), ["collection_year"])


_POINTS = f"{sql.SERO}, points AS (SELECT disease, round_even({sql.MID}, 1) AS age, sum(p * n) AS x, sum(n) AS n FROM sero WHERE p IS NOT NULL AND n > 0 GROUP BY ALL)"


def _age_points(spark, sf):
    rows = summary.sero(scan.split_provinces(scan.base_scan(observations(spark, sf))))
    return catalytic.age_points(rows, ["disease"], stats.age_midpoint(F.col("age_min"), F.col("age_max")), F.col("p"), F.col("n"))


@query(f"{_POINTS} SELECT disease, age, round(x, 4) AS x, n FROM points")
def age_points(spark, sf):
    return _age_points(spark, sf).select("disease", "age", F.round("x", 4).alias("x"), "n")


@query()
def age_curves(spark, sf):
    """Spline curve of every disease, one row for each half year."""
    made = curves.age_curves(_age_points(spark, sf), ["disease"])
    return made.select("disease", "n_ages", "penalty", "freedom", "falls", "sparse", F.explode("curve").alias("c")).select("disease", "n_ages", "penalty", "freedom", "falls", "sparse", "c.*")


@query()
def catalytic_models(spark, sf):
    return catalytic.fit_catalytic(_age_points(spark, sf), ["disease"])


@query()
def catalytic_given_reversion(spark, sf):
    return catalytic.fit_catalytic(_age_points(spark, sf), ["disease"], reversion=0.02)


@query()
def reversion_test(spark, sf):
    return catalytic.reversion_test(catalytic.fit_catalytic(_age_points(spark, sf), ["disease"]), ["disease"])


@query()
def catalytic_curve(spark, sf):
    points = _age_points(spark, sf).where(F.col("age") > 0)
    ends = points.groupBy("disease").agg(F.min("age").alias("youngest"), F.max("age").alias("oldest"))
    return catalytic.fitted_curve(catalytic.fit_catalytic(points, ["disease"]), ends, ["disease"])


def _titer_tables(spark, sf):
    """A table of titers for each third of the vectors: labels are antigens, dimensions sera."""
    vectors = table(spark, sf, "embeddings").select((F.col("vec_id") % 3).alias("table_id"), F.col("label").alias("antigen"), F.posexplode("embedding").alias("serum", "e"))
    cells = vectors.groupBy("table_id", "antigen", "serum").agg((10 + 1000 * F.abs(F.avg(F.col("e").cast("double")))).alias("titer"))
    return spatial.titer_distances(cells, ["table_id"])


@query()
def antigenic_maps(spark, sf):
    """The map of each table, one row for each antigen and serum."""
    made = antigenic.antigenic_maps(_titer_tables(spark, sf), ["table_id"])
    rows = made.select("table_id", "start", "stress_raw", "stress", "converged", F.explode("points").alias("p"))
    return rows.select("table_id", "start", F.round("stress_raw", 4).alias("stress_raw"), F.round("stress", 6).alias("stress"), "converged", "p.kind", "p.name", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query()
def map_likeness(spark, sf):
    """Each table's map against the next table's, by their common points."""
    maps = antigenic.antigenic_maps(_titer_tables(spark, sf), ["table_id"])
    following = maps.withColumn("table_id", (F.col("table_id") + 2) % 3)
    return antigenic.compared_maps(maps, following, ["table_id"])
