"""Chunks, places in raw texts, marks, numbered snapshots, hashes, kept results, and scores that follow reviews."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from titerlake.functions import passages
from titerlake.operators import grounding, snapshots
from titerlake.sources.shared import shared_folder
from titerlake.streaming import rescoring


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string")


def spans_by_hand(text):
    out, at, start = [], 0, None
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        if line.startswith("|"):
            start = at if start is None else start
        elif start is not None:
            out.append((start, at))
            start = None
        at += len(line)
    return out + ([(start, at)] if start is not None else [])


def chunks_by_hand(text, size, slack):
    tables = spans_by_hand(text)
    at, out = 0, []
    if len(text) <= size:
        return [(0, len(text))]
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            held = next((t for t in tables if t[0] < end < t[1]), None)
            if held and held[1] - at < 1.5 * size:
                end = held[1]
            else:
                limit = held[0] if held and held[0] > at else end
                cut = limit
                for mark in passages.SEPARATORS:
                    found = text.rfind(mark, max(at + size - slack, at), limit)
                    if found >= 0:
                        cut = found + len(mark)
                        break
                inside = next((t for t in tables if t[0] < cut < t[1] and t[0] > at), None)
                end = inside[0] if inside else cut
        if text[at:end].strip():
            out.append((at, end))
        at = end
    return out


def test_chunks_follow_separators_and_keep_tables_whole(spark):
    rng = random.Random(5)

    def piece():
        kind = rng.random()
        if kind < 0.25:
            return "".join(f"| {rng.randrange(99)} | b |\n" for _ in range(rng.randrange(1, 9)))
        return "".join(rng.choice(["word ", "一句。", "end. ", "line\n", "par\n\n", "x; ", " "]) for _ in range(rng.randrange(1, 30)))

    values = ["\n".join(piece() for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    values += ["", None, "a" * 950, " " * 700, "| a |\n" * 300, "x" * 90 + "\n" + "| a |\n" * 40 + "y" * 300, "no end", "| only"]
    frame = texts(spark, values)
    got = {r["i"]: r for r in frame.select("i", passages.table_spans(F.col("text")).alias("t"), passages.chunk_spans(F.col("text"), 200, 60).alias("c")).collect()}
    long = 0
    for i, text in enumerate(values):
        if text is None:
            assert got[i]["t"] is None
            continue
        assert [tuple(t) for t in got[i]["t"]] == spans_by_hand(text)
        assert [tuple(c) for c in got[i]["c"]] == chunks_by_hand(text, 200, 60), text
        for _, end in got[i]["c"]:
            for start, stop in spans_by_hand(text):
                if start < end < stop:
                    assert stop - start > 140  # only a table that no chunk holds is cut
                    long += 1
    assert long


def test_raw_spans_are_the_passage_itself(spark):
    rows = [("Alpha  beta\n\tgamma “delta” end", "betagamma"), ("  x y z w ", "xyzw"), ("abcd", "abcd"), ("a b", "zzzz"), ("", "abcd"), (None, "abcd"), ("gamma “delta” end", 'a"delta"e'), ("naïve café　crème", "cafécrème")]
    frame = spark.createDataFrame(rows, "text string, passage string")
    span = passages.raw_span(F.col("text"), grounding.located(grounding.squeezed(F.col("text")), F.col("passage")))
    out = [(r["text"][r["s"]["start"] : r["s"]["end"]] if r["s"] else None) for r in frame.select("text", span.alias("s")).collect()]
    assert out == ["beta\n\tgamma", "x y z w", "abcd", None, None, None, "a “delta” e", "café　crème"]
    around = frame.limit(1).select(passages.window(F.col("text"), F.struct(F.lit(7).alias("start"), F.lit(11).alias("end")), 3).alias("w")).first()["w"]
    assert (around["start"], around["end"], around["snippet"], around["marked_end"]) == (4, 14, "a  beta\n\tg", 11)


def test_marks_and_page(spark):
    frame = spark.createDataFrame([("a<b & 'c' d",)], "text string")
    mark = lambda s, e, i, c="high", g=True: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(i).alias("id"), F.lit(c).cast("string").alias("confidence"), F.lit(g).alias("grounded"))
    marks = F.array(mark(2, 5, "x<"), mark(0, 3, "y", None, False), mark(9, 99, "z"), mark(9, 10, "in z"), mark(-1, 4, "n"), mark(5, 5, "e"))
    row = frame.select(passages.marked(F.col("text"), marks).alias("m"), passages.marked(F.lit(None).cast("string"), marks).alias("none"), passages.trace_page(F.lit("T&"), F.col("text"), marks, F.array(F.struct(F.lit("y").alias("id"), F.lit("<s>").alias("summary")))).alias("p")).first()
    assert row["m"] == (
        '<mark id="hl-y" data-confidence="medium" style="border-style:dashed">a&lt;b</mark><mark id="hl-x&lt;" data-confidence="high" style="border-style:solid"> &amp;</mark>'
        ' &#x27;c&#x27;<mark id="hl-z" data-confidence="high" style="border-style:solid"> d</mark>'
    )
    assert row["none"] is None and row["m"] in row["p"] and '<a href="#hl-y">&lt;s&gt;</a>' in row["p"] and "<title>T&amp;</title>" in row["p"] and "<p>5 / 6</p>" in row["p"]


FACTS = "fact_id long, source_id long, review_status string, estimate_type string, value double, disease string"


def facts_of(spark, n=500):
    rows = [(i * 7919 % 100003, i % 20, "approved" if i % 3 else None, "primary" if i % 5 else "subgroup", None if i % 50 == 0 else i / 7, f"d{i % 4}") for i in range(n)]
    return spark.createDataFrame(rows, FACTS)


def test_numbers_run_in_order_through_all_partitions(spark):
    facts = facts_of(spark)
    for parts in (1, 7):
        rows = snapshots.numbered(facts.repartition(5), [F.col("fact_id").desc()], "n", parts).collect()
        assert [r["fact_id"] for r in sorted(rows, key=lambda r: r["n"])] == sorted((r["fact_id"] for r in rows), reverse=True)
        assert sorted(r["n"] for r in rows) == list(range(1, 501))
    assert snapshots.numbered(facts.limit(0), [F.col("fact_id")], "n").count() == 0


def test_hash_depends_on_rows_alone(spark):
    facts = facts_of(spark)
    one = snapshots.data_hash(facts).first()
    assert snapshots.data_hash(facts.repartition(9).orderBy(F.rand())).first() == one and one["n"] == 500 and re.fullmatch("[0-9a-f]{16}", one["data_hash"])
    changed = facts.withColumn("value", F.when(F.col("fact_id") == 7919, F.lit(1.5)).otherwise(F.col("value")))
    assert snapshots.data_hash(changed).first()["data_hash"] != one["data_hash"]
    assert snapshots.data_hash(facts.limit(0)).first()["n"] == 0
    got = spark.range(1).select(*[snapshots.canonical(F.lit(v).cast(k), k) for v, k in ((25.0, "double"), (None, "double"), (True, "boolean"), (None, "boolean"), (3, "int"))]).first()
    assert tuple(got) == ("25000000", "null", "1", "null", "3")
    assert snapshots.canonical_params({"b": 1, "a": "é", "c": None}) == snapshots.canonical_params({"a": "é", "b": 1}) == '{"a":"é","b":1}'


def test_snapshot_takes_approved_primary_facts_and_exports_them(spark, tmp_path):
    sources = spark.createDataFrame([(i, f"title {i}", 2000 + i) for i in range(19)], "source_id long, title string, pub_year int")
    rows = snapshots.snapshot_facts(facts_of(spark), sources, most=100)
    found = sorted(rows.collect(), key=lambda r: r["dp_id"])
    want = sorted(r["fact_id"] for r in facts_of(spark).collect() if r["review_status"] == "approved" and r["estimate_type"] == "primary")[:100]
    assert [r["fact_id"] for r in found] == want and [r["dp_id"] for r in found] == [f"dp_{k:04d}" for k in range(1, 101)]
    assert all((r["literature_title"] is None) == (r["source_id"] == 19) for r in found)
    snapshots.export_dataset(rows, f"file://{tmp_path}/set", {"disease": "d1", "province": None})
    csv = [f.read_bytes() for f in (tmp_path / "set" / "data_points").glob("*.csv")]
    assert all(c.startswith(b"\xef\xbb\xbfdp_id,disease,") for c in csv if c)
    assert sum(c.count(b"\n") - 1 for c in csv if c) == 100
    readme = next((tmp_path / "set" / "README").glob("part-*")).read_text()
    assert "Facts: 100" in readme and "disease: d1" in readme and "province" not in readme
    assert next((tmp_path / "set" / "data_dictionary").glob("*.csv")).read_text().startswith("field_name,data_type,description")


def test_results_are_kept_by_module_parameters_and_facts(spark):
    log = snapshots.Snapshots(spark, f"{shared_folder(spark)}/kept-{random.random()}")
    facts, calls = {"now": facts_of(spark)}, []

    def chosen(disease=None, **_):
        return facts["now"].where(F.col("disease") == disease) if disease else facts["now"]

    @snapshots.with_snapshot(log, "mean", chosen)
    def mean(disease=None, note=None):
        calls.append(disease)
        return chosen(disease).agg(F.round(F.avg("value"), 3).alias("mean"))

    first, token = mean(disease="d1")
    again, same = mean(disease="d1", note=None)
    assert token == same and calls == ["d1"] and first.collect() == again.collect() == log.read(token).collect()
    assert mean(disease="d2")[1] != token and calls == ["d1", "d2"]
    facts["now"] = facts["now"].withColumn("value", F.col("value") + 1)
    changed, other = mean(disease="d1")
    assert other != token and changed.first()["mean"] == pytest.approx(first.first()["mean"] + 1, abs=2e-3)
    assert log.read("none") is None


def event(fact, version, status, score, minute):
    return fact, version, status, score, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


EVENTS = "fact_id long, version long, review_status string, score int, updated_at timestamp"


def test_scores_follow_reviews_once_and_expire(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    inbox, out = tmp_path / "in", []
    inbox.mkdir()

    def put(name, *events):
        spark.createDataFrame(list(events), EVENTS).coalesce(1).write.parquet(f"file://{inbox}/{name}")

    def run():
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"file://{inbox}")
        query = rescoring.rescored(stream, keep="60 minutes", late="1 minutes").writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/state")
        query = query.foreachBatch(lambda frame, _: out.extend(tuple(r) for r in frame.collect())).trigger(availableNow=True).start()
        query.awaitTermination(180)
        got = sorted(out)
        out.clear()
        return got

    try:
        put("a", event(1, 1, "approved", 70, 0), event(2, 1, "pending", 10, 0), event(3, 5, "approved", 90, 1), event(1, 2, "approved", 75, 2))
        assert run() == [(1, 2, 75, "score"), (3, 5, 90, "score")]
        put("b", event(1, 1, "approved", 70, 3), event(1, 2, "approved", 75, 3), event(3, 4, "rejected", 0, 3))  # replays and older versions
        assert run() == []
        put("c", event(3, 6, "rejected", 0, 5), event(2, 2, "approved", 40, 5))
        assert run() == [(2, 2, 40, "score"), (3, 6, 90, "withdraw")]
        put("d", event(9, 1, "approved", 1, 200))
        put("e", event(9, 1, "approved", 1, 201))
        got = run()
        assert (9, 1, 1, "score") in got and {r[0] for r in got if r[3] == "expire"} == {1, 2, 3}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_upserts_and_the_batch_that_waits(spark):
    shape = "fact_id long, version long, score int"
    scores = spark.createDataFrame([(1, 1, 10), (2, 3, 20), (4, 1, 5)], shape)
    changes = spark.createDataFrame([(1, 2, 11, "score"), (2, 2, 99, "score"), (3, 1, 30, "score"), (4, 2, 5, "withdraw")], shape + ", action string")
    want = [(1, 2, 11), (2, 3, 20), (3, 1, 30)]
    once = rescoring.upsert_scores(scores, changes)
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, rescoring.upsert_scores(once, changes.where("action = 'score'")).collect())) == want
    facts = spark.createDataFrame([(i, "approved" if i % 2 else "pending", None if i % 3 else 5, i % 7) for i in range(40)], "fact_id int, review_status string, quality_score int, updated_at int")
    batch = rescoring.waiting_for_score(facts, 4).collect()
    want = sorted((i % 7, i) for i in range(40) if i % 2 and i % 3)[:4]
    assert [(r["updated_at"], r["fact_id"]) for r in batch] == want
