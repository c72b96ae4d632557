"""Permutation tests, curves by age, catalytic models and maps: known answers and recovered parameters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from titerlake.operators import antigenic, catalytic, curves, permutation, spatial


def lattice(spark, values):
    """A 4 x 4 lattice with edges between direct neighbours."""
    place = lambda r, c: f"p{r}{c}"
    cells = [(g, place(r, c), float(v[4 * r + c])) for g, v in values.items() for r in range(4) for c in range(4)]
    edges = [(place(r, c), place(r + a, c + b)) for r in range(4) for c in range(4) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= r + a < 4 and 0 <= c + b < 4]
    return spark.createDataFrame(cells, "g string, place string, x double"), spark.createDataFrame(edges, "src string, dst string")


def test_moran_tells_clusters_from_checkerboards(spark):
    halves = [10] * 8 + [90] * 8
    board = [10 if (k // 4 + k) % 2 else 90 for k in range(16)]
    noise = list(np.random.default_rng(5).permutation(16))
    values, edges = lattice(spark, {"halves": halves, "board": board, "noise": noise})
    got = {r["g"]: r for r in permutation.moran_test(values, edges, ["g"]).collect()}
    assert got["halves"]["pattern"] == "clustered" and got["halves"]["p_sim"] < 0.01 and got["halves"]["z_sim"] > 2
    assert got["board"]["pattern"] == "dispersed" and got["board"]["morans_i"] == -1 and got["board"]["p_sim"] == 0.001
    assert got["noise"]["pattern"] == "random" and got["noise"]["p_sim"] > 0.05
    one, known = lattice(spark, {"halves": halves})
    plain = spatial.morans_i(one.drop("g"), known).first()
    assert abs(plain["morans_i"] - got["halves"]["morans_i"]) < 1e-6


def test_moran_needs_eight_places_and_varied_values(spark):
    few, edges = lattice(spark, {"flat": [5] * 16})
    rows = permutation.moran_test(few, edges, ["g"], permutations=19).collect()
    assert rows[0]["n"] == 16 and rows[0]["p_sim"] is None
    seven = few.where("place < 'p13'")
    assert permutation.moran_test(seven, edges, ["g"], permutations=19).first()["morans_i"] is None
    assert permutation.moran_test(few.limit(0), edges, ["g"], permutations=19).count() == 0


def test_gi_star_permutation_finds_the_hot_corner(spark):
    values = list(np.random.default_rng(4).normal(size=16))
    for k in (0, 1, 4, 5):
        values[k] += 100
    frame, edges = lattice(spark, {"a": values})
    got = {r["place"]: r for r in permutation.gi_star_test(frame, edges, ["g"]).collect()}
    assert got["p00"]["degree"] == 2 and got["p00"]["p_sim"] < 0.05
    assert got["p00"]["p_sim"] < got["p32"]["p_sim"]
    # a place without neighbours keeps its own value in every permutation
    lonely = frame.unionByName(spark.createDataFrame([("a", "far", 3.0)], frame.schema))
    row = permutation.gi_star_test(lonely, edges, ["g"]).where("place = 'far'").first()
    assert (row["degree"], row["p_sim"]) == (0, 0.001)


def test_permutations_deal_each_value_once(spark):
    frame, _ = lattice(spark, {"a": range(16), "b": range(16, 32)})
    rows = permutation.permuted(frame, ["g"], 5, 7).collect()
    for g, base in (("a", 7.5), ("b", 23.5)):
        drawn = {}
        for r in rows:
            if r["g"] == g:
                drawn.setdefault(r["permutation"], []).append((r["place"], r["z"] + base))
        assert sorted(drawn) == list(range(6))
        for k, cells in drawn.items():
            assert sorted(v for _, v in cells) == [float(x) for x in (range(16) if g == "a" else range(16, 32))]
            assert (sorted(cells) == sorted(drawn[0])) == (k == 0)


def ages_of(spark, models, ages=range(1, 71), n=4000.0):
    rows = [(g, float(a), n * f(a), n) for g, f in models.items() for a in ages]
    return spark.createDataFrame(rows, "g string, age double, x double, n double")


def constant(a, rate=0.08):
    return 1 - math.exp(-rate * a)


def reversion(a, rate=0.12, back=0.03):
    return rate / (rate + back) * (1 - math.exp(-(rate + back) * a))


def two_phase(a, first=0.15, second=0.02, change=12):
    return 1 - math.exp(-(first * min(a, change) + second * max(0, a - change)))


def test_catalytic_models_recover_the_parameters(spark):
    points = ages_of(spark, {"constant": constant, "reversion": reversion, "two_phase": two_phase})
    fits = catalytic.fit_catalytic(points, ["g"])
    rows = {(r["g"], r["model"]): r for r in fits.collect()}
    assert len(rows) == 9
    c, r, t = rows["constant", "constant"], rows["reversion", "reversion"], rows["two_phase", "two_phase"]
    assert abs(c["rate"] - 0.08) < 1e-3 and c["second"] is None and c["second_lower"] is None and c["rate_lower"] < c["rate"] < c["rate_upper"]
    assert abs(r["rate"] - 0.12) < 1e-3 and abs(r["second"] - 0.03) < 1e-3
    assert abs(t["rate"] - 0.15) < 1e-3 and abs(t["second"] - 0.02) < 1e-3 and t["change_point"] == 12
    assert abs(t["average_force"] - (0.15 * 12 + 0.02 * 58) / 70) < 1e-3
    for g in ("constant", "reversion", "two_phase"):
        mine = [rows[g, m] for m in ("constant", "reversion", "two_phase")]
        assert abs(sum(m["weight"] for m in mine) - 1) < 1e-5
        assert [m["model"] for m in mine if m["recommended"]] == [g]
        assert all(m["aic"] == round(2 * k - 2 * m["loglik"], 3) for k, m in zip((1, 2, 3), mine, strict=True))
    # the information of the constant rate: sum of n a^2 (1 - p) / p
    information = sum(4000 * a * a * math.exp(-c["rate"] * a) / (1 - math.exp(-c["rate"] * a)) for a in range(1, 71))
    assert abs((c["rate_upper"] - c["rate_lower"]) / 2 - 1.96 / math.sqrt(information)) < 1e-5
    tests = {r["g"]: r for r in catalytic.reversion_test(fits, ["g"]).collect()}
    assert tests["constant"]["p_value"] > 0.5 and tests["reversion"]["p_value"] < 1e-6


def test_catalytic_given_reversion_and_odd_points(spark):
    points = ages_of(spark, {"reversion": reversion}).unionByName(spark.createDataFrame([("reversion", 0.0, 1.0, 9.0), ("reversion", -3.0, 1.0, 9.0), ("reversion", 9.0, 1.0, 0.0)], "g string, age double, x double, n double"))
    row = catalytic.fit_catalytic(points, ["g"], reversion=0.03).first()
    assert row["model"] == "fixed_reversion" and abs(row["rate"] - 0.12) < 1e-3 and row["second"] == 0.03 and row["n_ages"] == 70 and row["weight"] == 1
    all_positive = spark.createDataFrame([("g", 10.0, 50.0, 50.0), ("g", 20.0, 80.0, 50.0)], "g string, age double, x double, n double")
    assert {r["model"] for r in catalytic.fit_catalytic(all_positive, ["g"]).collect()} == {"constant", "reversion", "two_phase"}
    assert catalytic.fit_catalytic(points.limit(0), ["g"]).count() == 0


def test_fitted_curve_follows_the_recommended_model(spark):
    points = ages_of(spark, {"two_phase": two_phase})
    ends = points.groupBy("g").agg(F.min("age").alias("youngest"), F.max("age").alias("oldest"))
    curve = {r["age"]: r["prevalence"] for r in catalytic.fitted_curve(catalytic.fit_catalytic(points, ["g"]), ends, ["g"]).collect()}
    assert sorted(curve) == [float(a) for a in range(1, 71)]
    assert all(abs(curve[float(a)] - 100 * two_phase(a)) < 0.1 for a in range(1, 71))


def test_basis_sums_to_one_and_has_the_right_slope():
    knots = curves.knots_of(np.arange(0, 81, 4.0))
    x = np.linspace(0, 80, 161)
    b = curves.basis(x, knots)
    assert b.shape == (161, len(knots) - 4) and np.allclose(b.sum(1), 1)
    # coefficients at the Greville points give the identity
    greville = np.array([knots[i + 1 : i + 4].mean() for i in range(b.shape[1])])
    assert np.allclose(b @ greville, x)


def test_age_curves_follow_the_positivity_and_its_force(spark):
    falling = lambda a: 0.9 - 0.014 * a
    points = ages_of(spark, {"constant": constant, "falling": falling}, ages=range(1, 61), n=20000.0)
    points = points.unionByName(ages_of(spark, {"few": constant}, ages=range(1, 8))).unionByName(ages_of(spark, {"sparse": constant}, ages=[*range(1, 12), 30, 31]))
    rows = {r["g"]: r for r in curves.age_curves(points, ["g"]).collect()}
    assert set(rows) == {"constant", "falling", "sparse"}
    assert rows["falling"]["falls"] and not rows["constant"]["falls"] and rows["sparse"]["sparse"] and not rows["constant"]["sparse"]
    made = rows["constant"]["curve"]
    assert [c["age"] for c in made] == [1 + k / 2 for k in range(119)]
    for c in made:
        assert abs(c["prevalence"] - 100 * constant(c["age"])) < 1.0 and c["ci_lower"] <= c["prevalence"] <= c["ci_upper"]
    assert all(abs(c["force"] - 0.08) < 0.02 for c in made if 5 <= c["age"] <= 30)
    assert all(c["force"] == 0 for c in rows["falling"]["curve"][20:60])
    assert curves.curve_at(np.array([0.0]), curves.knots_of(np.array([0.0, 1.0])), np.full(7, 9.0), np.zeros((7, 7)))[0][4] is None  # nearly all positive


def test_maps_recover_a_configuration_up_to_rotation(spark):
    rng = np.random.default_rng(11)
    truth = rng.normal(size=(9, 2)) * 3
    wanted = np.sqrt(((truth[:, None] - truth[None]) ** 2).sum(2))
    best = min((antigenic.scaled(wanted, np.random.default_rng([0, k])) for k in range(20)), key=lambda m: m[1])
    assert best[1] < 1e-4 and best[3]
    rest, each = antigenic.procrustes(truth, best[0])
    assert rest < 1e-6 and each.max() < 1e-3
    turned = (truth @ np.array([[0.0, -1], [1, 0]])) * 5 + 7
    assert antigenic.procrustes(truth, turned)[0] == pytest.approx(0, abs=1e-12)
    assert antigenic.procrustes(truth, rng.normal(size=(9, 2)))[0] > 0.2


def test_antigenic_maps_and_their_likeness(spark):
    rng = np.random.default_rng(2)
    rows = [(g, a, s, 10.0 * 2 ** int(rng.integers(0, 8))) for g in ("x", "y") for a in range(6) for s in range(5)]
    rows += [("x", 9, s, 0.0 if s == 2 else 40.0) for s in range(5)]  # a titer at the limit: the antigen is left out
    cells = spark.createDataFrame(rows, "g string, antigen int, serum int, titer double")
    distances = spatial.titer_distances(cells, ["g"])
    maps = antigenic.antigenic_maps(distances, ["g"])
    got = {r["g"]: r for r in maps.collect()}
    for g in ("x", "y"):
        points = got[g]["points"]
        assert [(p["kind"], p["name"]) for p in points] == [("antigen", str(a)) for a in range(6)] + [("serum", str(s)) for s in range(5)]
        table = np.array([[r["distance"] for r in sorted((q for q in distances.where(F.col("g") == g).collect() if q["antigen"] == a), key=lambda q: q["serum"])] for a in range(6)])
        wanted, at = antigenic.joint_distances(table), np.array([(p["x"], p["y"]) for p in points])
        off = (wanted - np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))) ** 2
        assert abs(off.sum() / 2 - got[g]["stress_raw"]) < 1e-3 * off.sum() and np.allclose(off.sum(1), [p["stress"] for p in points], rtol=1e-3, atol=1e-6)
        alone = [antigenic.scaled(wanted, np.random.default_rng([0, k]))[1] for k in range(20)]
        assert abs(min(alone) - got[g]["stress_raw"]) < 1e-6
    same = antigenic.compared_maps(maps, maps, ["g"]).collect()
    assert all((r["n_common"], r["rest"], r["likeness"]) == (11, 0.0, 1.0) for r in same)
    other = antigenic.compared_maps(maps.where("g = 'x'"), maps.where("g = 'y'").withColumn("g", F.lit("x")), ["g"]).first()
    assert 0 < other["rest"] <= 1 and other["likeness"] == pytest.approx(1 - other["rest"] ** 2, abs=1e-5)
