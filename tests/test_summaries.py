"""Cells, standardised rates, gaps and names by value."""

import pytest
from pyspark.sql import functions as F

from titerlake.functions import names, wording
from titerlake.operators import cells, gaps, grounding, scan
from titerlake.plans.catalog import QUERIES


def obs(spark, rows):
    return spark.createDataFrame(rows, "place string, data_type string, value double, sample_size int")


def test_cells_merge_studies_and_keep_odd_ones(spark):
    rows = [("a", "seroprevalence", 50.0, 100), ("a", "seroprevalence", 50.0, 200), ("a", "gmc", 100.0, 5), ("a", "gmc", 2000.0, 5), ("a", "gmc", 30000.0, 5), ("a", "gmc", -1.0, 5)]
    rows += [("b", "gmc", 10.0, 3), ("c", "seroprevalence", 250.0, 10), (None, "seroprevalence", 1.0, 40), ("d", "seroprevalence", 30.0, None)]
    got = {r["place"]: r for r in cells.cell_summary(obs(spark, rows), ["place"]).collect()}
    a = got["a"]
    assert (a["rate"], a["method"], a["model"], a["i2"], a["k"], a["rate_weighted"], a["total_sample"], a["n_points"]) == (50.0, "meta", "fixed", 0.0, 2, 50.0, 300, 6)
    assert a["gmc"] == pytest.approx(1817.12, rel=1e-3) and a["n_values"] == 3 and a["ci_lower"] < 50 < a["ci_upper"]
    assert (got["b"]["rate"], got["b"]["method"], got["b"]["gmc"]) == (None, None, 10.0)
    assert (got["c"]["rate"], got["c"]["method"]) == (None, None)
    assert (got[None]["rate"], got[None]["total_sample"]) == (100.0, 40)
    assert got["d"]["rate"] is None and got["d"]["n_points"] == 1
    assert cells.cell_summary(obs(spark, []), ["place"]).count() == 0


def test_two_cells_compared_and_their_trend(spark):
    rows = spark.createDataFrame([("x", "p", 40.0, 100), ("x", "q", 60.0, 100), ("y", "p", 0.0, 50), ("y", "q", 50.0, 50), ("z", "p", 10.0, 10)], "g string, place string, rate double, total_sample int")
    got = {r["g"]: r for r in cells.compared_cells(rows, "place", "p", "q", ["g"]).collect()}
    assert set(got) == {"x", "y"} and got["x"]["rd"] == -0.2 and got["x"]["rr"] == pytest.approx(40 / 60, abs=1e-4)
    assert got["y"]["rr"] == pytest.approx((0.5 / 51) / 0.5, abs=1e-4)
    years = spark.createDataFrame([(1, 2000, 10.0, 100), (1, 2001, 20.0, 100), (1, 2002, 30.0, 100), (1, 2003, None, 100), (2, 2000, 5.0, 10)], "g int, year int, rate double, total_sample int")
    rows = {r["g"]: r for r in cells.trend_of_cells(years, ["g"], "year").collect()}
    assert (rows[1]["slope"], rows[1]["direction"], rows[1]["k"]) == (10.0, "up", 3) and rows[1]["z"] > 3
    assert rows[2]["slope"] is None and rows[2]["z"] is None


def test_standardised_rates(spark):
    strata = spark.createDataFrame([("g", "a", 0.5, 100.0), ("g", "b", 0.6, 100.0), ("g", "c", 0.4, 100.0), ("g", "other", 0.9, 10.0), ("g", "a", None, 5.0), ("h", "a", 0.5, 10.0), ("h", "b", 0.5, 10.0)], "g string, band string, rate double, n double")
    got = {r["g"]: r for r in cells.standardised(strata, ["g"], {"a": 0.2, "b": 0.3, "c": 0.5}).collect()}
    error = (0.04 * 0.25 / 100 + 0.09 * 0.24 / 100 + 0.25 * 0.24 / 100) ** 0.5
    assert (got["g"]["asr"], got["g"]["crude"], got["g"]["n_strata"]) == (48.0, 50.0, 3)
    assert got["g"]["ci_lower"] == pytest.approx(48 - 195.9964 * error, abs=1e-3) and got["g"]["error"] == pytest.approx(100 * error, abs=1e-4)
    assert (got["h"]["asr"], got["h"]["n_strata"]) == (None, 2)


def test_binomial_interval_chooses_its_method(spark):
    rows = spark.createDataFrame([(0.0, 10.0), (10.0, 10.0), (15.0, 30.0), (1.0, 0.0)], "x double, n double")
    low, high, method = cells.binomial_interval(F.col("x"), F.col("n"))
    got = [tuple(r) for r in rows.select(F.round(low, 4), F.round(high, 4), method).collect()]
    assert got == [(0.0, 0.3085, "exact"), (0.6915, 1.0, "exact"), (0.3315, 0.6685, "wilson"), (None, None, None)]


def test_gap_lists(spark):
    rows = [("P;Q", "c1", 2000, "m", "approved", "A")] * 5 + [("P", "c2；c3", 2000, "m", "pending", None)] * 2 + [("Q", None, 2001, "m", "approved", "C")] * 5 + [(None, None, None, "n", "rejected", None), ("Q", "", 0, "n", "odd", "A")]
    counts = gaps.base_counts(spark.createDataFrame(rows, "province string, city string, collection_year int, disease string, review_status string, quality_grade string"))
    assert gaps.overview(counts).first().asDict() == {"total": 14, "pending": 2, "approved": 10, "rejected": 1, "diseases": 2, "years": 2, "provinces": 2, "cities": 3}
    review = [r.asDict() for r in gaps.review_needed(counts).collect()]
    assert [(r["province"], r["collection_year"], r["approved_ab"], r["pending"], r["completeness"], r["status"]) for r in review] == [("P", 2000, 5, 2, 66.0, "need_review")]
    lacking = [(r["province"], r["collection_year"], r["disease"], r["approved"], r["approved_ab"], r["total"], r["completeness"]) for r in gaps.supplement_needed(counts).collect()]
    assert lacking == [("Q", 0, "n", 0, 0, 1, 0.0), ("Q", 2001, "m", 5, 0, 5, 0.0)]
    cover = {r["disease"]: (r["covered"], r["missing"], r["percent"]) for r in gaps.coverage(counts, ["P", "Q", "R"]).collect()}
    assert cover == {"m": (["P", "Q"], ["R"], 66.67), "n": (["Q"], ["P", "R"], 33.33)}
    whole = {r["province"]: (r["total"], r["completeness"]) for r in gaps.year_matrix(counts).where("whole").collect()}
    assert whole == {"P": (7, 66.0), "Q": (6, 0.0)}


def each(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["o"] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_names_follow_each_rule(spark):
    assert each(spark, names.standard_method, ["ELISA", "Elisa kit", "化学发光法检测", "WESTERN BLOT", "x-ray", "", None]) == ["ELISA", "ELISA", "CLIA", "WB", "x-ray", None, None]
    assert each(spark, names.standard_antibody, ["IGG", "anti-IgM", "中和抗体滴度", "other"]) == ["IgG", "IgM", "Neutralizing Ab", "other"]
    assert each(spark, names.standard_province, ["广东", "广东省", "Tibet", "黑龙江省哈尔滨", "粤", "青岛市", "beijing", None]) == ["广东", "广东", "西藏", "黑龙江", "广东", "青海", "beijing", None]
    assert len(names.PROVINCES) == 34 * 3 + 39 and list(names.PROVINCES)[:3] == ["北京", "北京市", "Beijing"] and names.PROVINCES["新疆维吾尔自治区"] == "新疆"
    groups = {"儿童": "儿童", "学生": "学生", "医": "医护"}
    assert each(spark, lambda c: names.standard_group(c, groups), ["儿童", "小学生", "3~6岁组", "≥65岁", "18岁以上", "30岁成人", "医", "医生", " ", ""]) == ["儿童", "学生", "儿童", "老年人", "儿童", "成人", "医护", "医生", "", None]
    table = spark.createDataFrame([(2, "b", "B"), (1, "a", "A")], "position int, alias string, name string")
    assert list(names.disease_aliases(table).items()) == [("a", "A"), ("b", "B")]
    with pytest.raises(ValueError):
        names.disease_aliases(table, most=1)


def test_scan_compares_standard_names_and_gender(spark):
    rows = spark.createDataFrame([("Measles", "men"), ("麻疹病毒", "women, men"), ("mumps", "men"), (None, "men")], "disease string, population string")
    rows = rows.withColumns({"review_status": F.lit("approved"), "estimate_type": F.lit("primary"), "quality_grade": F.lit("A")})
    aliases = {"measles": "measles", "麻疹": "measles"}
    assert scan.base_scan(rows, disease="麻疹", aliases=aliases).count() == 2
    assert scan.base_scan(rows, disease="measles", gender="WOMEN", aliases=aliases).count() == 1
    assert scan.base_scan(rows, disease="麻疹").count() == 0


def test_numbers_and_confidence_as_people_write_them(spark):
    rows = spark.createDataFrame([("rate was 0.0005 here", 0.0005), ("all 12345678.5 of them", 12345678.5), ("84.3%", 84.3), ("215 people", 215.0), ("5.0E-4", 0.0005), ("none", None), ("big 123456789012", 123456789012.0)], "t string, v double")
    got = [r["g"] for r in rows.select(grounding.numbers_found(F.col("t"), F.lit(None).cast("string"), F.array("v")).alias("g")).collect()]
    assert got == [True, True, True, True, False, True, True]
    assert each(spark, wording.score_confidence, [" High", "MEDIUM ", "low", None]) == [5, 3, 1, 1]


def test_passages_that_state_their_numbers_are_grounded(spark):
    rows = QUERIES["passage_grounding"](spark, "/root/testdata/sf0.001").collect()
    assert all(r["grounded"] for r in rows if r["source_id"] % 5 == 1 and r["method"]) and not any(r["grounded"] for r in rows if r["source_id"] % 5 == 0)
    assert sum(r["grounded"] for r in rows) > 20
