"""Containment joins, ranked look-ups, merges and imports by value."""

import json
import random

import pytest
from pyspark.sql import functions as F

from titerlake.operators import linkage, matching, merging
from titerlake.sources.adapters import evidence_sources
from titerlake.sources.shared import shared_folder


def test_containing_equals_all_pairs(spark):
    rng = random.Random(3)
    holders = ["".join(rng.choice("ab.c") for _ in range(rng.randrange(0, 14))) for _ in range(80)] + ["", None, "%_%", "ÀÉ漢字"]
    needles = ["".join(rng.choice("ab.c") for _ in range(rng.randrange(0, 7))) for _ in range(80)] + ["", None, "_", "漢", "zzzz", "zzzzzz"]
    a, b = (spark.createDataFrame([(x,) for x in v], f"{n} string") for v, n in ((needles, "needle"), (holders, "holder")))
    plan = matching.containing(a, b)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = [tuple(r) for r in matching.containing(a, b).collect()]
    want = {(x, y) for x in needles if x for y in holders if y and x in y}
    assert len(got) == len(want) and set(got) == want
    assert matching.containing(a.limit(0), b).count() == matching.containing(a, b.limit(0)).count() == 0
    both = matching.either_containing(a.withColumnRenamed("needle", "left"), b.withColumnRenamed("holder", "right")).collect()
    assert {tuple(r) for r in both} == {(x, y) for x in needles if x for y in holders if y and (x in y or y in x)}


def test_ranked_lookup_takes_the_first_rank_and_the_least_row(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, None, "y"), (5, "c", None)], "i int, p string, q string")
    exact = spark.createDataFrame([("a", "x", 9, None), ("a", "x", 3, 7), (None, "y", 1, 1)], "p string, q string, pos int, v int")
    wide = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 1, None)], "p string, pos int, v int")
    got = matching.ranked_lookup(rows, [("exact", exact, ["p", "q"]), ("wide", wide, ["p"])], ["v"], "pos").orderBy("i").collect()
    assert [(r["i"], r["v"], r["rank"]) for r in got] == [(1, 7, "exact"), (2, 10, "wide"), (3, None, "wide"), (4, None, None), (5, None, None)]


def test_orphan_files(spark):
    uid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    sources = spark.createDataFrame([(uid, "store\\a\\paper one.pdf"), ("2", None), ("3", "http://host/x/part.docx")], "source_id string, file_path string")
    names = ["paper one.pdf", "http://host/x/part.docx", "art.do", f"{uid}.txt", f"{uid[:-1]}f.txt", "gone.pdf", "3.txt", None]
    got = {r["name"]: r["reason"] for r in matching.orphan_files(spark.createDataFrame([(n,) for n in names], "name string"), sources).collect()}
    assert got == {"paper one.pdf": "name", "http://host/x/part.docx": "name", "art.do": "part", f"{uid}.txt": "id", f"{uid[:-1]}f.txt": None, "gone.pdf": None, "3.txt": None}


def test_parents_by_name_then_first(spark):
    shape = "fact_id int, source_id int, disease string, data_type string, estimate_type string, province string, city string, parent_group string"
    rows = [
        (1, 1, "m", "s", "primary", "P", "C", None), (2, 1, "m", "s", "primary", "Q", None, None), (3, 1, "n", "s", "primary", "P", None, None), (9, 2, "m", "s", "primary", "", "", None),
        (10, 1, "m", "s", "subgroup", None, None, "all of Q"), (11, 1, "m", "s", "subgroup", None, None, "C of Q"), (12, 1, "m", "s", "subgroup", None, None, ""), (13, 1, "m", "s", "subgroup", None, None, None),
        (14, 1, "m", "s", "subgroup", None, None, "elsewhere"), (15, 1, "m", "g", "subgroup", None, None, ""), (16, 2, "m", "s", "subgroup", None, None, "x"), (17, 2, None, "s", "subgroup", None, None, ""),
    ]
    got = {r["fact_id"]: (r["parent_id"], r["rank"]) for r in matching.link_to_parents(spark.createDataFrame(rows, shape)).collect()}
    assert got == {10: (2, "named"), 11: (1, "named"), 12: (1, "first"), 13: (1, "first"), 14: (None, None), 15: (None, None), 16: (None, None), 17: (None, None)}


FACTS = "fact_id int, source_id int, disease string, province string, collection_year int, data_type string, value double, review_status string"
SOURCES = "source_id int, title string, journal string, keywords array<string>, extracted_count int, approved_count int"


def merge_case(spark):
    facts = [
        (1, 1, "m", "P", 2000, "s", 10.0, "approved"), (2, 1, "m", None, 0, "s", 20.0, "pending"), (3, 1, "m", "Q", 2001, "s", 1.0, "pending"),
        (4, 2, "m", "P", 2000, "s", 11.0, "approved"), (5, 2, "m", "", None, "s", 21.0, "pending"), (6, 2, "m", "P", 2000, "s", 12.0, "approved"), (7, 2, "m", "R", 2001, "s", 2.0, "approved"),
        (8, 3, "m", "P", 2000, "s", 13.0, "approved"),
    ]
    sources = [(1, "one", None, ["a", "b"], 0, 0), (2, "two", "J", ["b", "c"], 9, 9), (3, "three", "K", None, 5, 5), (4, "four", None, ["z"], 4, 4)]
    return spark.createDataFrame(sources, SOURCES), spark.createDataFrame(facts, FACTS), spark.createDataFrame([(2, 1), (4, 3), (3, 3), (9, 1)], "source_id int, target_id int")


@pytest.mark.parametrize(("strategy", "kept", "moved", "dropped", "approved"), [("keep_both", {1, 2, 3, 4, 5, 6, 7, 8}, 4, 0, 4), ("prefer_target", {1, 2, 3, 7, 8}, 1, 3, 2), ("prefer_source", {3, 4, 5, 6, 7, 8}, 4, 2, 3)])
def test_merge_strategies(spark, strategy, kept, moved, dropped, approved):
    sources, facts, merges = merge_case(spark)
    new_sources, new_facts, report = merging.merge_sources(sources, facts, merges, {"journal": "source", "keywords": "merge", "title": "target"}, strategy)
    rows = {r["fact_id"]: r["source_id"] for r in new_facts.collect()}
    assert set(rows) == kept and all(s == (3 if f == 8 else 1) for f, s in rows.items())
    counts = {r["target_id"]: tuple(r)[1:] for r in report.collect()}
    assert counts == {1: (moved, dropped, len(kept) - 1, approved), 3: (0, 0, 1, 1)}
    after = {r["source_id"]: tuple(r)[1:] for r in new_sources.collect()}
    assert after == {1: ("one", "J", ["a", "b", "c"], len(kept) - 1, approved), 3: ("three", None, ["z"], 1, 1)}
    # what was merged is gone, so nothing is left to merge
    again = merging.merge_sources(new_sources, new_facts, merges, {}, strategy)
    assert again[2].count() == 0 and sorted(map(str, again[0].collect())) == sorted(map(str, new_sources.collect())) and again[1].count() == len(kept)


def test_merge_refuses_wrong_choices_and_chains(spark):
    sources, facts, _ = merge_case(spark)
    for choices, strategy in (({"journal": "both"}, "keep_both"), ({"none": "source"}, "keep_both"), ({}, "random")):
        with pytest.raises(ValueError):
            merging.merge_sources(sources, facts, sources.selectExpr("source_id", "1 target_id"), choices, strategy)[2].collect()
    chain = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (4, 1)], "source_id int, target_id int")
    assert sorted(tuple(r) for r in merging.valid_merges(sources, chain).collect()) == [(2, 3)]


def test_fields_are_compared(spark):
    sources, _, _ = merge_case(spark)
    merges = spark.createDataFrame([(2, 1)], "source_id int, target_id int")
    got = [tuple(r) for r in merging.compared_fields(sources, merges, ["title", "journal"]).orderBy("field").collect()]
    assert got == [(2, 1, "journal", "J", None, True), (2, 1, "title", "two", "one", True)]


def test_replaced_facts_keep_approved_ones(spark):
    _, facts, _ = merge_case(spark)
    new = spark.createDataFrame([(90, 1, "m", "N", 2010, "s", 5.0, "pending")], FACTS)
    assert {r["fact_id"] for r in merging.replace_facts(facts, new).collect()} == {4, 5, 6, 7, 8, 90}
    assert {r["fact_id"] for r in merging.replace_facts(facts, new, keep_approved=True).collect()} == {1, 4, 5, 6, 7, 8, 90}


def export_file(spark, tmp, entries):
    (tmp / "export.json").write_text(json.dumps({"literatures": entries}))
    return merging.read_export(spark, f"file://{tmp}/export.json")


LIBRARY = "source_id long, title string, authors string, journal string, pub_year int, doi string, province string, abstract string, extraction_status string, source_db string"


def test_json_import_skips_completes_and_repeats_nothing(spark, tmp_path):
    sources = spark.createDataFrame([(1, "Known", "A", None, 2000, "10.1/x", None, "", "done", "db"), (2, "Other", None, None, None, None, None, None, "none", "db")], LIBRARY)
    shape = "fact_id long, source_id long, disease string, province string, data_type string, value double, estimate_type string, review_status string, extra string"
    facts = spark.createDataFrame([(1, 1, "m", "P", "s", 10.0, "primary", "approved", None)], shape)
    fact = {"disease": "m", "province": "P", "data_type": "s", "value": 10.0, "review_status": "approved"}
    entries = export_file(spark, tmp_path, [
        {"title": " Known by doi ", "doi": "10.1/x", "journal": "J", "pub_year": 0, "data_points": [fact, {**fact, "value": 11.0}]},
        {"title": "Other", "authors": "B", "doi": "10.1/none"},
        {"title": "New", "doi": "10.1/n", "abstract": "first", "data_points": [{"disease": "n", "value": 1.0}]},
        {"title": "New again", "doi": "10.1/n", "abstract": "second", "province": "Q"},
        {"title": "New again", "abstract": "third"},
        {"title": "  ", "doi": "10.1/q"}, {"doi": "10.1/r"},
    ])
    out, added, counts = merging.import_export(sources, facts, entries)
    assert counts.first().asDict() == {"imported": 2, "updated": 0, "skipped": 3, "without_title": 2, "facts_added": 1}
    rows = {r["title"]: r for r in out.collect()}
    assert set(rows) == {"Known", "Other", "New", "New again"} and rows["Known"]["journal"] is None
    assert (rows["New"]["abstract"], rows["New"]["source_db"], rows["New"]["extraction_status"]) == ("first", "import", "done")
    fresh = added.where("disease = 'n'").first()
    assert (fresh["source_id"], fresh["estimate_type"], fresh["review_status"]) == (rows["New"]["source_id"], "primary", "pending")

    out, added, counts = merging.import_export(sources, facts, entries, skip_duplicates=False)
    assert counts.first().asDict() == {"imported": 2, "updated": 3, "skipped": 0, "without_title": 2, "facts_added": 2}
    rows = {r["title"]: r for r in out.collect()}
    assert (rows["Known"]["journal"], rows["Known"]["pub_year"], rows["Known"]["authors"]) == ("J", 2000, "A")
    assert rows["Other"]["authors"] == "B" and (rows["New"]["abstract"], rows["New"]["province"]) == ("second", "Q") and rows["New again"]["abstract"] == "third"
    again = merging.import_export(out, added, entries, skip_duplicates=False)
    assert again[2].first()["facts_added"] == 0 and again[2].first()["imported"] == 0
    assert sorted(map(str, again[0].collect())) == sorted(map(str, out.collect())) and again[1].count() == added.count()


def test_store_shows_whole_versions(spark):
    root = f"{shared_folder(spark)}/store-{random.random()}"
    store = merging.Store(spark, root)
    assert store.version == 0
    sources, facts, merges = merge_case(spark)
    assert store.commit(sources=sources, facts=facts) == 1
    new_sources, new_facts, _ = merging.merge_sources(store.read("sources"), store.read("facts"), merges, {}, "prefer_target")
    assert store.commit(facts=new_facts) == 2
    other = merging.Store(spark, root)
    assert other.version == 2 and other.read("facts").count() == 5 and other.read("sources").count() == 4
    store.commit(sources=new_sources)
    assert other.read("sources").count() == 2 and other.read("facts").count() == 5
    # tables of a commit that didn't come to its end are seen by nobody
    facts.limit(1).write.parquet(f"{root}/facts/version=4")
    assert other.version == 3 and other.read("facts").count() == 5


def test_best_title_match_prefers_the_most_alike_then_the_first(spark):
    sources = spark.createDataFrame([(5, "Measles immunity in the north of the country"), (3, "measles IMMUNITY in the north of the country!"), (2, "Measles immunity in the north of a country"), (9, "")], "source_id int, title string")
    names = spark.createDataFrame([("f", "Measles immunity in the north of the country"), ("g", "measles immunity north of a country"), ("h", "quite other words"), ("i", None)], "name string, title string")
    got = {r["name"]: (r["source_id"], r["similarity"]) for r in merging.best_title_match(names, sources).collect()}
    assert got == {"f": (3, 1.0), "g": (2, 0.75)}


@pytest.mark.parametrize("least", [0.7, 0.5])
def test_best_title_match_equals_all_pairs(spark, least):
    rng = random.Random(11)
    titles = [[f"w{rng.choice((rng.randrange(6), rng.randrange(60)))}" for _ in range(rng.choice((1, 2, 3, 4, 6, 8, 12)))] for _ in range(120)]
    titles += [t[:i] + t[i + 1 :] + rng.choice(([], ["w70"], ["w71", "W72!"])) for t in titles[:90] for i in (rng.randrange(len(t)),)]
    ids = rng.sample(range(1000), len(titles))
    names = [(f"n{i % 230}", t[: i % 5] + t[i % 5 + i % 4 :]) for i, t in enumerate(titles + titles[:40])]  # some names have two titles
    sources = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, titles, strict=True)] + [(1001, ""), (1002, None)], "source_id long, title string")
    frame = spark.createDataFrame([(n, "-".join(t)) for n, t in names] + [("none", None)], "name string, title string")
    sets = {i: {w.lower().strip("!") for w in t} for i, t in zip(ids, titles, strict=True) if t}
    want = {}
    for n, t in names:
        q = set(w.lower().strip("!") for w in t)
        scored = [(-len(q & k) / len(q | k), i) for i, k in sets.items() if q and len(q & k) / len(q | k) >= least]
        if scored:
            want[n] = min(*scored, want.get(n, (0, 0)))
    want = {n: (i, round(-s, 4)) for n, (s, i) in want.items()}
    got = [tuple(r) for r in merging.best_title_match(frame, sources, least).select("name", "source_id", "similarity").collect()]
    assert len(got) == len(want) and {n: (i, s) for n, i, s in got} == want
    assert {1.0} < {s for _, s in want.values()} and len({s for _, s in want.values()}) > 5


def test_titles_that_lack_a_word_are_settled_by_keys(spark, monkeypatch):
    """A group of alike titles, some names of which are equal: pairs that are compared grow with the titles, not with their square."""
    met, likeness, n = spark.sparkContext.accumulator(0), linkage.likeness, 300
    seen = F.udf(lambda _: met.add(1) or 0.0, "double")
    monkeypatch.setattr(linkage, "likeness", lambda x, y: likeness(x, y) + seen(F.size(x)))
    sources = spark.createDataFrame([(i, f"a b x{i} c d e f g") for i in range(n)], "source_id long, title string")
    names = spark.createDataFrame([(f"{c}{i}", "a b c d e f g" if c == "p" else f"a b x{i} d e f g") for i in range(n) for c in "pq"], "name string, title string")
    got = {r["name"]: (r["source_id"], r["similarity"]) for r in merging.best_title_match(names, sources).collect()}
    assert got == {f"{c}{i}": (0 if c == "p" else i, 0.875) for i in range(n) for c in "pq"}
    assert met.value < 20 * n


def test_alike_sets_share_a_signature_and_others_rarely_do(spark):
    rng = random.Random(5)
    sets = [frozenset(rng.sample(range(40), rng.choice((1, 2, 3, 5, 8, 12)))) for _ in range(150)]
    for s in list(sets):
        sets.append(frozenset(list(s)[: -1 if rng.random() < 0.5 else None]) | ({rng.randrange(40)} if rng.random() < 0.6 else set()))
    sets += [frozenset(range(100, 150)), frozenset(range(100, 160)), frozenset(range(300)), frozenset(range(250)), frozenset([1, 2, 50, 51]), frozenset([1, 2, 60, 61])]
    sets = [s for s in sets if s]
    for least in (0.7, 0.5):
        frame = spark.createDataFrame([(i, [f"{x:03d}" for x in sorted(s)]) for i, s in enumerate(sets)], "i int, o array<string>")
        own = {r["i"]: set(r["s"]) for r in frame.select("i", linkage.signatures(F.col("o"), least).alias("s")).collect()}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                assert len(a & b) / len(a | b) < least or own[i] & own[j], (a, b)
    few = spark.createDataFrame([(["a", "b", *(f"{i}-{k}" for k in range(6))],) for i in range(30)], "o array<string>").select(F.explode(linkage.signatures(F.col("o"), 0.7)).alias("s"))
    assert few.groupBy("s").count().where("count > 1").count() == 0  # two words in common bring no titles together


def test_title_is_the_opening_of_the_text(spark, tmp_path):
    texts = ["a b", " a  b\tc\nd e f g h i", "a b c d e f g ", "a b c d e f g  h", "", "  ", "x" * 3000, None, "a b c d e f g h ", " a 　b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source", "'l' AS lang", "0L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    rows = evidence_sources(spark, str(tmp_path)).select("title", F.array_join(F.slice(words, 1, 8), " ").alias("want")).collect()
    assert len(rows) == len(texts) and all(r["title"] == r["want"] for r in rows)
