"""Seven bibliography formats, many files at once."""

import pytest
from pyspark.sql import functions as F

from titerlake.sources import references

RIS = "﻿TY  - JOUR\r\nTI  - A long\r\n title\r\nAU  - Lee, A\r\nAU - Wu, B\r\nJO  - Journal\r\nPY  - 2020/03/01\r\nDO  - 10.1/X\r\nAB  - First part\r\nsecond part.\r\nKW  - one\r\nKW  - two\r\nSN  - 1234\r\nER  - \r\nafter the end\r\nTY  - JOUR\r\nAU  - Nobody\r\nER  - \r\nTY  - BOOK\r\nTI  - Last\r\n"
ENW = "%0 Journal Article\n%T Title one\n%A Ann\n%A Bob\n%J Press\n%D 1999\n%7 10.2/b\n%X Abs\ncontinues\n%K k1\n%K k2\n%@ 555\n%0 Journal Article\n%T Title two\n%R 10.2/c\n%7 10.2/d\n"
WOS = "FN Thomson\nVR 1.0\nPT J\nAU Li, C\n   Ma, D\nTI Immunity of\n   children\nSO VACCINE\nPY 2011\nDI 10.3/w\nAB Words\n   more words\nDE a; b\nUT WOS:0001\nSN 0264\nX no tag\n   of a line that is none\nER\n\nPT J\nTI Second\nER\nEF\n"
PUBMED_RIS = "PMID- 111\nOWN - NLM\nTI  - On measles\n      in cities\nFAU - Ray, E\nAU  - Ray E\nTA  - Short\nJT  - The Long Journal\nDP  - 2015 Mar 2\nLID - S0001 [pii]\nLID - 10.4/p [doi]\nAB  - Text\nPMC - PMC9\n\nPMID- 112\nTI  - Other\nSO  - Old Press. 1987;2(1):3.\n"
PUBMED = """1. Vaccine. 2018 Jun 7;36(24):3455-3459. doi: 10.5/q.

Seroprevalence of measles
in the north.

Fox A(1), Gray B(2).

Author information:
(1)Institute.

BACKGROUND: First line
goes on.

RESULTS: 2. In addition, more.

Copyright © 2018.

DOI: 10.5/q.
PMCID: PMC77;
PMID: 2900

2. A plain title
Author X, Author Y
Some Journal. 2001;3:4.
OBJECTIVE: To see.
More of it.
PMID: 55
tail

3. Title alone

Writer Z

Journal Q, 1995; 2.

Body here.

PMID: 77
"""
CSV = '"PT","AU","TI","SO","PY","DI","AB"\n"J","Kim, F; Cho, G","A, quoted ""title""","PRESS",2009,"10.6/t","two\nlines"\n"J","","","X",2000,"",""\n'
TSV = "TI\tSO\tPY\nTabbed\tS\t2003\nSecond\tT\t2004\n"
DUXIU = "1. [期刊]\n题 名：麻疹抗体\n作 者：张三 李四\n出 处：中国疫苗; 12; 2013, 4(2)\n关键词：麻疹;抗体\n摘 要：内容 文字\nISSN：1006\n2. [期刊]\n题名：第二\n"
TEXTS = {"ris": RIS, "enw": ENW, "wos": WOS, "pubmed_ris": PUBMED_RIS, "pubmed": PUBMED, "woscsv": CSV, "duxiu": DUXIU, "none": "free text\nonly", "empty": "  \n"}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("refs")
    for name, text in {**TEXTS, "tsv": TSV}.items():
        (folder / f"{name}.txt").write_bytes(text.encode())
    files = references.read_files(spark, f"file://{folder}")
    out = {}
    for r in references.parse_references(files).collect():
        out.setdefault(r["file"].rsplit("/", 1)[1][:-4], []).append(r)
    return {k: sorted(v, key=lambda r: r["record"]) for k, v in out.items()}


def test_formats_are_detected_in_order(spark):
    rows = spark.createDataFrame(list(TEXTS.items()), "name string, text string").select("name", references.detected_format(F.col("text")).alias("f")).collect()
    assert {r["name"]: r["f"] for r in rows} == {**{k: k for k in TEXTS}, "none": None, "empty": None}


def test_nothing_comes_of_free_text(parsed):
    assert set(parsed) == {"ris", "enw", "wos", "pubmed_ris", "pubmed", "woscsv", "duxiu", "tsv"}
    assert {k: [r["title"] for r in v] for k, v in parsed.items()} == {
        "ris": ["A long title", "Last"], "enw": ["Title one", "Title two"], "wos": ["Immunity of children", "Second"], "pubmed_ris": ["On measles in cities", "Other"],
        "pubmed": ["Seroprevalence of measles in the north.", "A plain title", "Title alone"], "woscsv": ['A, quoted "title"'], "tsv": ["Tabbed", "Second"], "duxiu": ["麻疹抗体", "第二"],
    }


def fields(r, *names):
    return tuple(r[n] for n in names)


def test_tagged_formats(parsed):
    r = parsed["ris"][0]
    assert fields(r, "authors", "journal", "year", "pub_date", "doi", "abstract", "keywords", "issn", "source") == ("Lee, A; Wu, B", "Journal", "2020", "2020/03/01", "10.1/X", "First part second part.", "one; two", "1234", "cnki")
    assert fields(parsed["ris"][1], "authors", "year", "doi") == ("", "", "")
    r = parsed["enw"][0]
    assert fields(r, "authors", "journal", "year", "doi", "abstract", "keywords", "issn") == ("Ann; Bob", "Press", "1999", "10.2/b", "Abs continues", "k1; k2", "555")
    assert parsed["enw"][1]["doi"] == "10.2/c"
    r = parsed["wos"][0]
    assert fields(r, "authors", "journal", "year", "doi", "abstract", "keywords", "pmid", "issn", "source") == ("Li, C; Ma, D", "VACCINE", "2011", "10.3/w", "Words more words", "a; b", "WOS:0001", "0264", "wos")
    r = parsed["pubmed_ris"][0]
    assert fields(r, "authors", "journal", "year", "pub_date", "doi", "abstract", "pmid", "pmcid", "url") == ("Ray, E; Ray E", "The Long Journal", "2015", "2015 Mar 2", "10.4/p", "Text", "111", "PMC9", "https://pubmed.ncbi.nlm.nih.gov/111/")
    assert fields(parsed["pubmed_ris"][1], "journal", "doi", "year") == ("Old Press", "", "")


def test_numbered_formats(parsed):
    r = parsed["pubmed"][0]
    assert fields(r, "authors", "journal", "year", "pub_date", "doi", "pmid", "pmcid") == ("Fox A(1), Gray B(2)", "Vaccine", "2018", "2018 Jun 7", "10.5/q", "2900", "PMC77")
    assert r["abstract"] == "BACKGROUND: First line goes on. RESULTS: 2. In addition, more."
    r = parsed["pubmed"][1]
    assert fields(r, "authors", "journal", "abstract", "pmid") == ("Author X, Author Y", "Some Journal", "", "55")
    r = parsed["pubmed"][2]
    assert fields(r, "authors", "journal", "year", "abstract") == ("Writer Z", "Journal Q", "1995", "Journal Q, 1995; 2. Body here.")
    r = parsed["duxiu"][0]
    assert fields(r, "authors", "journal", "year", "keywords", "abstract", "issn", "source") == ("张三 李四", "中国疫苗", "2013", "麻疹;抗体", "内容 文字", "1006", "duxiu")
    assert parsed["duxiu"][1]["journal"] == ""


def test_delimited_format(parsed):
    r = parsed["woscsv"][0]
    assert fields(r, "authors", "journal", "year", "doi", "abstract") == ("Kim, F; Cho, G", "PRESS", "2009", "10.6/t", "two\nlines")
    assert [fields(r, "journal", "year") for r in parsed["tsv"]] == [("S", "2003"), ("T", "2004")]


def test_a_named_format_and_an_unknown_one(spark):
    files = spark.createDataFrame([("a", ENW), ("b", RIS)], "file string, text string")
    assert [r["title"] for r in references.parse_references(files, "enw").orderBy("record").collect()] == ["Title one", "Title two"]
    with pytest.raises(ValueError):
        references.parse_references(files, "marc")
    assert references.parse_references(files.limit(0)).count() == 0


def test_written_records_read_back(spark, parsed, tmp_path):
    rows = [tuple(r[f] for f in references.FIELDS) for f in ("ris", "enw", "wos") for r in parsed[f]]
    frame = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in references.FIELDS))
    references.write_ris(frame, f"file://{tmp_path}/out")
    back = references.read_references(spark, f"file://{tmp_path}/out").collect()
    kept = ("title", "authors", "journal", "year", "doi", "abstract")
    assert sorted(fields(r, *kept) for r in back) == sorted(tuple(dict(zip(references.FIELDS, r, strict=True))[f] for f in kept) for r in rows)


def test_texts_are_computed_once_for_all_readers(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = [*TEXTS.items(), ("null", None)]
    files = spark.createDataFrame(rows, "file string, text string").withColumn("text", counted("text"))
    assert {r["file"] for r in references.parse_references(files).collect()} == set(TEXTS) - {"none", "empty"}
    assert seen.value == len(rows)


def test_records_are_cut_once_for_all_fields(spark):
    files = spark.createDataFrame([("a", PUBMED), ("b", DUXIU)], "file string, text string")
    for read in (references.read_pubmed, references.read_duxiu):
        plan = read(files)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("slice(lines") == 1 and plan.count("array_join(slice") == 1
