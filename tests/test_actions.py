"""Extracted records, titles and review actions by value."""

import datetime as dt

from pyspark.sql import functions as F

from titerlake.functions import titles
from titerlake.operators import records, reviews
from titerlake.plans.catalog import QUERIES
from tests.compare import SF


def each(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["o"] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_titles_from_file_names(spark):
    values = ["C:\\x\\2019_2020-01-02 - 麻疹调查 (3).pdf", "a/b/Study of x.PDF", "2011.DOCX", "title_副本", "2020年报告", None, " .pdf", "2020-13-01 x"]
    assert each(spark, titles.from_file_name, values) == ["麻疹调查", "Study of x", "2011", "title", "2020年报告", None, " .pdf", "13-01 x"]
    values = ["血清学调查_苏中华", "麻疹_风疹_腮腺炎抗体_张三_李四丰", "麻_疹_风_x", "plain_name", "张三"]
    assert each(spark, titles.repaired, values) == ["血清学调查", "麻疹/风疹/腮腺炎抗体", "麻/疹/风_x", "plain_name", "张三"]


def record(spark, *maps):
    return spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, record map<string,string>")


def test_records_take_standard_names_and_types(spark):
    rows = records.standard_records(record(
        spark,
        {"seroprevalence": "87.3％", "virus": "measles", "detection_method": "elisa kit", "province": "广东省", "ci": "(95% CI 16.2%–19.5%)", "age_min": " 3 ", "sample_size": "1,2", "estimate_type": "total"},
        {"gmt": "1,234", "disease_name": "x", "estimate_type": "subgroup", "positivity_ci_lower": "5", "ci": "1, 2", "gmc_ci_upper": "high"},
        {"before_positivity_rubella_IgG": ">80", "after_seroprevalence_mumps": "90", "x": "1"},
        {"before_positivity_rubella_IgG": ">80", "positivity_rate": "10", "gmc": "5", "gmt": "7"},
        {}, None,
    ), {"measles": "MEASLES"}).orderBy("i").collect()
    a, b, c, d, e, f = rows
    assert (a["positivity_rate"], a["disease_name"], a["detection_method"], a["province"], a["positivity_ci_lower"], a["positivity_ci_upper"]) == (87.3, "MEASLES", "ELISA", "广东", 16.2, 19.5)
    assert (a["age_min"], a["sample_size"], a["estimate_type"]) == (3, None, "primary")
    assert (b["gmc_value"], b["gmc_unit"], b["estimate_type"], b["positivity_ci_lower"], b["positivity_ci_upper"], b["gmc_ci_upper"]) == (1234.0, "titer", "subgroup", 5.0, None, None)
    assert (c["positivity_rate"], c["disease_name"]) == (90.0, "mumps")
    assert (d["positivity_rate"], d["disease_name"], d["gmc_value"], d["gmc_unit"]) == (10.0, None, 5.0, None)
    assert (e["positivity_rate"], e["estimate_type"], f["positivity_rate"], f["estimate_type"]) == (None, "primary", None, "primary")


def test_a_record_gives_up_to_two_facts(spark):
    made = records.facts_of(records.standard_records(record(spark, {"positivity_rate": "50", "gmc_value": "7", "gmc_unit": "IU", "sample_year": "0", "study_start_year": "2001"}, {"gmc": "3", "sample_year": "2005"}, {"city": "x"})))
    assert sorted((r["i"], r["data_type"], r["value"], r["unit"], r["collection_year"]) for r in made.collect()) == [(0, "gmc", 7.0, "IU", 2001), (0, "seroprevalence", 50.0, "%", 2001), (1, "gmc", 3.0, None, 2005)]


def test_what_many_fields_of_a_record_come_from_is_computed_once(spark):
    plan = QUERIES["record_facts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp") < 60


def test_titer_tables_are_taken_whole_or_not_at_all(spark):
    shape = "table_id int, assay_type string, antigens array<string>, ref_antisera array<string>, titers array<array<string>>"
    rows = [
        (1, " HAI ", ["a", "b"], ["s"], [["<10"], ["40"]]), (2, "pcr", ["a"], ["s"], [["1"]]), (3, "hi", ["a", "b"], ["s"], [["1"]]), (4, "hi", ["a"], ["s", "t"], [["1"]]),
        (5, "hi", [], ["s"], []), (6, "hi", None, ["s"], [["1"]]), (7, "elisa", ["a"], ["s", "t"], [["-", "x"]]), (8, "hi", ["a"], ["s"], [None]), (9, None, ["a"], ["s"], [["1"]]),
    ]
    got = sorted(tuple(r) for r in records.titer_tables(spark.createDataFrame(rows, shape)).collect() if r["table_id"] != 7)
    assert got == [(1, "hi", "a", "s", 0.0), (1, "hi", "b", "s", 40.0)]
    assert [r["titer"] for r in records.titer_tables(spark.createDataFrame(rows, shape)).where("table_id = 7").collect()] == [None, None]


def test_verdicts_restores_renames_and_tags(spark):
    facts = spark.createDataFrame([(1, 1, "pending", None, None, None), (2, 1, "pending", "old", 5, None), (3, 2, None, None, None, None)], "fact_id int, source_id int, review_status string, review_comment string, reviewer_id int, reviewed_at timestamp")
    day = lambda d: dt.datetime(2024, 1, d)
    verdicts = spark.createDataFrame([(1, 1, "rejected", "a", 7, day(1)), (1, 1, "approved", None, 8, day(2)), (3, 1, "approved", "no", 9, day(1))], "fact_id int, source_id int, status string, comment string, reviewer_id int, reviewed_at timestamp")
    got = {r["fact_id"]: tuple(r)[2:5] for r in reviews.reviewed(facts, verdicts).collect()}
    assert got == {1: ("approved", None, 8), 2: ("pending", "old", 5), 3: (None, None, None)}
    sources = spark.createDataFrame([(1, day(1), 4), (2, day(2), 4), (3, None, None)], "source_id int, deleted_at timestamp, deleted_by int")
    back = {r["source_id"]: (r["deleted_at"], r["deleted_by"]) for r in reviews.restored(sources, sources.where("source_id < 2")).collect()}
    assert back == {1: (None, None), 2: (day(2), 4), 3: (None, None)}
    named = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "d string")
    rows, changed = reviews.renamed(named, "d", F.when(F.col("d") == "a", "z").otherwise(F.col("d")))
    assert sorted(r["d"] or "" for r in rows.collect()) == ["", "b", "z", "z"] and [tuple(r) for r in changed.collect()] == [("a", "z", 2)]
    bridge = spark.createDataFrame([(1, "x"), (2, "y"), (3, "w")], "source_id int, tag string")
    tags = reviews.retagged(bridge, spark.createDataFrame([(1, ["n", "m", "n"]), (2, [])], "source_id int, tags array<string>"))
    assert sorted(map(tuple, tags.collect())) == [(1, "m"), (1, "n"), (3, "w")]


def test_reviewers_rest_and_rejected(spark):
    stats = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (None, 8)], "reviewer_id int, n int")
    users = spark.createDataFrame([(1, "Ann", "a"), (2, "", "bob"), (4, "x", "y")], "reviewer_id int, display_name string, username string")
    assert {r["n"]: r["reviewer"] for r in reviews.named_reviewers(stats, users).collect()} == {5: "Ann", 6: "bob", 7: "3", 8: None}
    facts = spark.createDataFrame([(i, "rejected" if i % 2 else "approved", dt.datetime(2024, 1, 1 + i) if i != 5 else None) for i in range(8)], "fact_id int, review_status string, reviewed_at timestamp")
    assert sorted(r["fact_id"] for r in reviews.unapproved(facts, facts.where("review_status = 'approved'")).collect()) == [1, 3, 5, 7]
    last = reviews.recent_rejected(facts, F.array(F.lit("p"), F.lit("q")), 3).collect()
    assert [(r["fact_id"], r["issues"]) for r in last] == [(7, "p; q"), (3, "p; q"), (1, "p; q")]
