"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from titerlake.llm import chat, jaccard, language, lines, mixing, packing, quality, secrets, telephony, tokenids
from titerlake.llm.scratch import Scratch

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, spans string, n int, tokens int, root int, block int, token string, "
    "size int, window int, bin int, key string, h1 long, line string, pos int, first int, media_kind string, probability string, score string, f1 long"
)
LONG = "lorem ipsum dolor sit amet " * 30000
TEXTS = [(1, "the same line of words here\nend of it all"), (2, "the same line of words here\nother"), (2, "the same line of words here\nother"), (3, None), (4, ""), (5, LONG), (6, LONG), (None, "password = hunter22 and more words"), (7, " \n\t"), (8, "x")]


def frame(spark, rows=TEXTS):
    width = SCHEMA.count(",") + 1
    return spark.createDataFrame([(i, t, "en" if i != 2 else None, None if i == 1 else "s", None, *[None] * (width - 5)) for i, t in rows], SCHEMA)


def per_row(name, spark, docs):
    if name == "secrets":
        return secrets.scan_secrets(docs)
    if name == "quality":
        labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (8, None)], "doc_id long, quality int")
        return quality.score_quality(docs, quality.train(docs, labels))
    if name == "language":
        return language.predict(docs, language.train(docs.select("doc_id", "text", "lang")))
    if name == "telephony":
        return telephony.expand_telephony(telephony.store_texts(docs))
    if name == "lines":
        return lines.dedup_lines(docs)
    if name == "mixing":
        return mixing.mix_sources(docs)
    if name == "jaccard":
        return jaccard.jaccard_components(docs)
    import public_tokenizers

    path = Scratch(spark, "case").path("ids")
    tokenids.write_token_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenids.read_token_ids(spark, path)


NAMES = ["secrets", "quality", "language", "telephony", "lines", "mixing", "jaccard", "tokens"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_every_row(spark, name):
    got = [r["doc_id"] for r in per_row(name, spark, frame(spark)).collect()]
    assert sorted(got, key=str) == sorted((i for i, _ in TEXTS), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert per_row(name, spark, frame(spark, [])).count() == 0


def test_lines_keep_the_first_document(spark):
    got = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(frame(spark)).select("doc_id", "text").collect()}
    assert (1, TEXTS[0][1]) in got and (2, "other") in got and (3, "") in got and (None, TEXTS[7][1]) in got


CLASH = [f"__{c}" for c in ("id", "version", "lines", "gone", "n_lines", "source", "hash", "size", "part", "k", "at", "quota", "inside", "offset", "slot", "block", "start")]


@pytest.mark.parametrize("name", ["lines", "mixing"])
def test_columns_of_internal_names_keep_their_values(spark, name):
    docs = frame(spark, [(i, t) for i, t in TEXTS if i != 5]).select("doc_id", "text", "source")
    for k, c in enumerate(CLASH):
        docs = docs.selectExpr("*", f"{k} + coalesce(doc_id, 0) * 100 AS `{c}`")
    out = per_row(name, spark, docs)
    taken = {"__n_lines", "__n_dropped"} if name == "lines" else {"__slot", "__block", "__start"}
    assert len(out.columns) == len(set(out.columns)) and taken <= set(out.columns)
    for r in out.collect():
        assert all(r[c] == k + (r["doc_id"] or 0) * 100 for k, c in enumerate(CLASH) if c not in taken)


def test_secret_values(spark):
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in secrets.scan_secrets(frame(spark)).collect()}
    assert got[None] == [("assign", 0, 19)] and all(got[i] == [] for i in (1, 2, 3, 4, 5, 6, 7, 8))


def test_quality_values(spark):
    rows = per_row("quality", spark, frame(spark)).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_dup_lines"], r["base_failed"]) for r in rows}
    assert got[3] == got[4] == got[7] == (0, 0, 0, True) and got[8] == (1, 1, 0, True) and got[5] == got[6] and got[5][0] == 150000
    one_kind = spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, quality int")
    kept = quality.score_quality(frame(spark, [(9, " ".join(f"w{i}" for i in range(60)))]), quality.train(frame(spark), one_kind)).first()
    assert kept["kept"] and kept["probability"] is None


def test_language_values(spark):
    got = {r["doc_id"]: r for r in per_row("language", spark, frame(spark)).collect()}
    assert all(got[i]["lang_pred"] == "und" and 0 <= got[i]["score"] <= 1 for i in (3, 4, 7)) and got[5]["lang_pred"] == got[6]["lang_pred"]


def test_token_values(spark):
    rows = per_row("tokens", spark, frame(spark)).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == tokenids.END_ID
        at += r["n_tokens"]
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["start"] == 0 and by[3]["ids"] == by[4]["ids"] == by[7]["ids"] == [1] and by[5]["ids"] == by[6]["ids"]


def test_mixing_keeps_repeated_and_null_ids_in_small_parts(spark):
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN NULL ELSE 7 END AS doc_id", "repeat('x', int(id % 50)) || id AS text", "IF(id % 10 = 0, NULL, 's') AS source")
    out = mixing.mix_sources(docs, part_rows=100, block_chars=500)
    rows = sorted(out.collect(), key=lambda r: (r["source"] or "", r["__start"]))
    assert len(rows) == 3000 and len({r["text"] for r in rows}) == 3000
    at = {}
    for r in rows:
        assert r["__start"] == at.get(r["source"], 0)
        at[r["source"]] = r["__start"] + len(r["text"])
    weights = mixing.slot_counts({"a": 0.0, "b": -1.0, "c": 3.0}, 10)
    assert weights == {"a": 1, "b": 1, "c": 8}


def test_packing_windows_hold_repeated_ids(spark):
    docs = spark.range(2000).selectExpr("NULL AS doc_id", "'same words' AS text", "'s' AS source").selectExpr("CAST(doc_id AS long) AS doc_id", "text", "source")
    rows = packing.pack_documents(docs, window_rows=100).groupBy("window").count().collect()
    assert sum(r["count"] for r in rows) == 2000 and max(r["count"] for r in rows) < 200


def test_jaccard_cases(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark)).collect()}
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[7] == (0, 7) and got[8] == (1, 8)
    assert got[6][1] == 5 and got[5][1] == 5 and got[None][1] is None


def test_packing_cases(spark):
    rows = packing.pack_documents(frame(spark)).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in TEXTS}
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 150001
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_chat_cases(spark):
    turns = [(1, 1, "assistant", "hi <|im_end|>\n~ <~|im_start|>"), (1, 0, None, None), (2, 0, "user\nx\\", ""), (3, 0, "assistant", None), (3, 0, "assistant", None), (None, 0, "assistant", "z")]
    rows = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, head string")
    examples = chat.expand_prefix_targets(rows)
    got = {r["conv_id"]: r for r in chat.digest_examples(examples).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (2, len(turns[0][3])), 2: (1, 0), 3: (2, 0), None: (1, 1)}
    back = examples.where("conv_id = 2").select(chat.read_turns(examples["formatted"]).alias("t")).first()["t"]
    assert (back[0]["role"], back[0]["text"]) == ("user\nx\\", "")
    assert chat.expand_prefix_targets(rows.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [TEXTS, []], ids=["cases", "empty"])
def test_pipeline_stages(spark, rows):
    docs = frame(spark, rows)
    scratch = Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.save(stage(spark, docs, ""), name.replace(" ", "-"))
        assert after.columns == docs.columns
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    if rows:
        left = [r["doc_id"] for r in docs.collect()]
        assert 5 in left and 6 not in left and 3 not in left


def test_pipeline_runs_whole(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.identify_language(spark, docs, sf)
    assert first.count() >= 0.95 * docs.count()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_packing_and_mix_follow_from_the_rows_alone(spark):
    """Another split of the input, and columns that only pass through, change nothing; equal rows are dealt out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    docs = docs.unionByName(docs.where("doc_id % 50 = 0")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    shaped = docs.repartition(7).withColumn("extra", F.lit("x")).withColumn("number", F.monotonically_increasing_id())

    def rows(frame):
        return sorted((tuple(r) for r in frame.collect()), key=str)

    assert rows(packing.pack_documents(docs, window_rows=300)) == rows(packing.pack_documents(shaped, window_rows=300))
    mixed = [f.select("doc_id", "source", "__block", "__slot", "__start") for f in (mixing.mix_sources(docs, part_rows=200, block_chars=5000), mixing.mix_sources(shaped, part_rows=200, block_chars=5000))]
    assert rows(mixed[0]) == rows(mixed[1])
    same = docs.limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(900)))).drop("copy")
    windows = [r["n"] for r in packing.pack_documents(same, window_rows=300).where("piece = 0").groupBy("window").agg(F.count("*").alias("n")).collect()]
    assert len(windows) == 3 and min(windows) > 200


def test_a_mix_goes_on_when_a_source_runs_out(spark):
    rows = [(i, "small" if i < 5 else "large", "x" * 100) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"small": 0.5, "large": 0.5}
    out = mixing.mix_sources(docs, weights, slots=10, block_chars=100).collect()
    by_slot = sorted((r["__slot"], r["source"], r["__block"]) for r in out)
    assert [b for _, s, b in by_slot if s == "small"] == list(range(5)) and [b for _, s, b in by_slot if s == "large"] == list(range(195))
    assert len({slot for slot, _, _ in by_slot}) == 200
    for n in range(1, 11):  # while both have blocks, each is within less than one block of half the slots
        assert abs(sum(s == "small" for slot, s, _ in by_slot if slot < n) - n / 2) < 1
    tail = [slot for slot, s, _ in by_slot if s == "large" and slot >= 10]
    assert all(b - a in (1, 2, 3) for a, b in zip(tail, tail[1:], strict=False))  # the small one's later slots stay empty


def test_files_without_part_numbers_keep_their_windows_apart(spark, tmp_path):
    for name in ("one", "two"):
        frame = spark.createDataFrame([(i, name, f"{name} {i}") for i in range(10)], "doc_id long, source string, text string").coalesce(1)
        frame.write.parquet(f"file://{tmp_path}/w-{name}")
        (made,) = (tmp_path / f"w-{name}").glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        made.rename(tmp_path / "all" / f"{name}.parquet")
    got = packing.pack_documents(spark.read.parquet(f"file://{tmp_path}/all"), in_file_order=True).collect()
    assert len({r["file"] for r in got}) == 2 and len(got) == 20
