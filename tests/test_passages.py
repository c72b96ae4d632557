"""Passages, copies and intervals against plain Python."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.compare import SF
from tests.test_values import each
from titerlake.functions import passages, wording
from titerlake.operators import duplicates, grounding, spans
from titerlake.plans.catalog import QUERIES
from titerlake.sources.shared import Tables


def table_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@pytest.mark.parametrize("a, b", [("", "x"), ("abcbdab", "bdcaba"), ("aaaa", "aa"), ("血清阳性率84.3%", "阳性 84.3"), ("x" * 90, "xy" * 45), ("abc", "xyz")])
def test_common_subsequence(a, b):
    assert grounding.lcs_length(a, b) == table_lcs(a, b) == grounding.lcs_length(b, a)


def test_locations(spark):
    cases = [("ab cd efgh", "cd ef", (2, 6)), ("abcdefgh", "abc", None), ("xxabcdefyy", "##abcdef##", (2, 10)), ("“q” said", '"q"sa', (0, 5)), ("a　bcde", "abcd", (0, 4)), (None, "abcd", None), ("abcd", None, None), ("zzzzabcd", "abcd!", (4, 8))]
    rows = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, t string, p string")
    got = rows.select("i", grounding.located(grounding.squeezed(F.col("t")), grounding.squeezed(F.col("p"))).alias("s")).orderBy("i").collect()
    assert [tuple(r["s"]) if r["s"] else None for r in got] == [c[2] for c in cases]


def test_cascade(spark):
    text = "In the year of the survey 84.3% of 215 people in Zhejiang were found positive by ELISA."
    cases = [
        (text, "84.3% of 215 people", [84.3, 215.0], "exact", True),
        (text, "84.3% of 215 people", [84.4], "exact", False),
        (text, "8x.3%xof 21x pexple in Zhxjiang", [215.0], "fuzzy", True),
        (text, "nothing like it whatsoever, 99999", [215.0], "keyphrase", True),
        (text.replace("Zhejiang", "town").replace("ELISA", "test"), "nothing like it whatsoever, 99999", [], None, False),
        (None, "84.3% of 215 people", [], None, False),
        ("", None, [], None, False),
    ]
    rows = spark.createDataFrame([(i, t, p, n) for i, (t, p, n, _, _) in enumerate(cases)], "i int, t string, p string, n array<double>")
    got = grounding.ground(rows, "t", "p", F.array(F.lit("Zhejiang"), F.lit("ELISA"), F.lit(None)), F.col("n")).orderBy("i").collect()
    assert [(r["method"], r["grounded"]) for r in got] == [c[3:] for c in cases]
    squeezed = "".join(text.split())
    fuzzy = got[2]
    scores = {s: table_lcs(squeezed[s : fuzzy["end"] - fuzzy["start"] + s], "".join(cases[2][1].split())) for s in range(0, len(squeezed) - 46 + 1, 8)}
    assert scores[fuzzy["start"]] == max(scores.values())
    phrase = got[3]
    assert (phrase["start"], phrase["end"]) == (squeezed.index("Zhejiang") - 10, len(squeezed))


def test_grounding_over_documents(spark):
    found = QUERIES["passage_grounding"](spark, SF).collect()
    assert len({r["source_id"] for r in found}) == len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {"exact", "fuzzy"} <= {r["method"] for r in found} and not any(r["grounded"] for r in found if r["source_id"] % 5 == 0 or r["method"] is None)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(8, 60)]
    got = {r["node"]: r["root"] for r in duplicates.components(spark.createDataFrame(chain + star + [(5, 2), (2, 9)], "a long, b long"), Tables(spark, "test")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 2 for i in [2, 5, *range(7, 60)]) and len(got) == 116
    assert duplicates.components(spark.createDataFrame([], "a long, b long"), Tables(spark, "test")).count() == 0


def test_duplicate_reasons(spark):
    shape = "source_id long, title string, authors string, doi string, file_hash string, created_at int"
    rows = [
        (1, "A study of one thing", "Lee, A", "10.1/X", None, 9), (2, "Another", "Wu", "10.1/x", "h", 3), (3, "Third", None, None, "h", 5),
        (4, "Study of one thing, a!", "Lee, B", None, None, 7), (5, None, None, "", "", 1), (6, "", None, None, None, 1),
        (7, "some title", "", None, None, 2), (8, "Some-Title", "Else", None, None, 2), (9, "quite alone", "Lee", None, None, 2),
    ]
    got = {r["group_id"]: (r["n_sources"], r["reasons"], r["representative_id"]) for r in duplicates.duplicate_components(spark.createDataFrame(rows, shape)).collect()}
    assert got == {1: (4, "doi,file_hash,title+authors", 2), 7: (2, "title", 7)}


def test_spans(spark):
    rows = [("a", 0, 5), ("a", 5, 7), ("a", 1, 2), ("a", 9, 12), ("a", 10, 15), ("a", 0, 5), ("b", 3, 3), (None, 1, 4)]
    frame = spark.createDataFrame(rows, "k string, start int, end int")
    assert sorted((tuple(r) for r in spans.merged(frame, ["k"]).collect()), key=str) == sorted([("a", 0, 7, 3), ("a", 9, 15, 2), ("b", 3, 3, 1), (None, 1, 4, 1)], key=str)
    shown = [tuple(r) for r in spans.visible(frame, ["k"]).collect()]
    assert sorted(shown, key=str) == sorted([("a", 0, 5), ("a", 5, 7), ("a", 9, 12), ("a", 12, 15), (None, 1, 4)], key=str)
    for (k, s, e), (m, t, f) in combinations(shown, 2):
        assert k != m or e <= t or f <= s


def test_text_parts(spark):
    assert each(spark, lambda t: wording.truncated(t, 10), ["short", "12345678\nabc", "1\n34567890abc", "0123456789ab", None]) == ["short", "12345678", "1\n34567890", "0123456789", None]
    assert each(spark, wording.table_rows, ["|a|b|\n|---|:-:|\n|1|2|\n |3|4| ", "no table", "|---|", None]) == [2, 0, 0, 0]
    assert each(spark, wording.reference_list, ["x\nReferences \n[1] A\n(2) B\n3. C\nD\n", "no list", "参考文献\n1) A", None]) == [["[1] A", "(2) B", "3. C"], [], ["1) A"], None]
    assert each(spark, lambda t: wording.focused(t, ["key"], 5, 2, 0), ["a\nKEY\nb\nkey", "a\nb", "x\ny\nz\nw"]) == ["KEY\nkey", "a\nb", "x\ny"]
    assert each(spark, lambda t: wording.listed_price(t, {"a-mini": (1.0, 2.0), "a": (3.0, 4.0)})["inward"], ["A-mini-2", "a-2", "b", None]) == [1.0, 3.0, None, None]


def test_duplicate_components_compute_their_sources_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        seen.add(1)
        return title

    rows = spark.createDataFrame([(i, f"one title of {i // 2}", "A, B") for i in range(40)], "source_id long, title string, authors string")
    sources = rows.select("source_id", counted("title").alias("title"), "authors", F.lit("2020-01-01").cast("date").alias("created_at"), F.lit(None).cast("string").alias("file_hash"), F.lit("").alias("doi"))
    assert duplicates.duplicate_components(sources).count() == 20
    assert seen.value == 40


def test_windows_are_measured_together(monkeypatch):
    calls, slow = [], grounding.lcs_length
    monkeypatch.setattr(grounding, "lcs_length", lambda a, b: calls.append(1) or slow(a, b))
    rng = random.Random(8)
    for n in (6, 20, 63, 64, 65):
        for text in ("", "é", "".join(rng.choice("abc漢😀") for _ in range(300))):
            part = "".join(rng.choice("abcd漢") for _ in range(n))
            window, step = min(len(text), n + 20), max(1, n // 3)
            starts = range(0, max(1, len(text) - window + 1), step)
            before = len(calls)
            assert grounding._covered(text, part, starts, window) == [slow(text[i : i + window], part) for i in starts]
            assert n > 64 or len(calls) == before


def test_raw_place_reads_an_opening_first(spark):
    texts = ["a b  c", " 　x", "   ", "", "ab " * 200, " " * 300 + "abcdef", "a" + " " * 200 + "b"]
    rows = spark.createDataFrame([(t, p) for t in texts for p in (-1, 0, 1, 2, 5, 130, 399, 400)], "t string, p int")
    for r in rows.select("t", "p", passages.raw_place(F.col("t"), F.col("p")).alias("g")).collect():
        solid = [i for i, c in enumerate(r["t"]) if not c.isspace()]
        assert r["g"] == (solid[r["p"]] if 0 <= r["p"] < len(solid) else None), r
    plan = rows.select(passages.raw_place(F.col("t"), F.col("p")).alias("g"))._jdf.queryExecution().toString()
    assert "substring(t" in plan or "substr(t" in plan
