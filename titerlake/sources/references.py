"""Bibliographies in seven formats: detection, and records from the lines of many files at once.

Line formats are read as gaps and islands: each line gets the last tag before it and the number of records begun so far, so a
continuation line is one more line of its field. Numbered formats are cut at their record heads. Files are rows of ``file``
and ``text``; every reader returns ``file, record`` and ``FIELDS``, blank where a record doesn't say.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titerlake.sources.shared import Tables

FIELDS = ("title", "authors", "journal", "year", "pub_date", "doi", "pmid", "pmcid", "abstract", "keywords", "source", "url", "issn", "institution")
#: Tags of each field in the line formats: joined by blanks, joined by semicolons, or the last line alone (fixed values).
TAGS = {
    "ris": {"title": (" ", "TI"), "authors": (";", "AU"), "journal": (" ", "JO", "JF"), "pub_date": ("last", "PY"), "doi": ("last", "DO"), "abstract": (" ", "AB"), "keywords": (";", "KW"), "url": ("last", "UR"), "issn": ("last", "SN"), "institution": (" ", "AD")},
    "enw": {"title": (" ", "T"), "authors": (";", "A"), "journal": (" ", "J"), "pub_date": ("last", "D"), "doi": ("last", "R"), "abstract": (" ", "X"), "keywords": (";", "K"), "url": ("last", "U"), "issn": ("last", "@")},
    "wos": {"title": (" ", "TI"), "authors": (";", "AU"), "journal": (" ", "SO"), "pub_date": ("last", "PY"), "doi": ("last", "DI"), "abstract": (" ", "AB"), "keywords": (";", "DE"), "pmid": ("last", "UT"), "issn": ("last", "SN")},
    "pubmed_ris": {"title": (" ", "TI"), "authors": (";", "FAU", "AU"), "journal": ("last", "JT"), "pub_date": ("last", "DP"), "abstract": (" ", "AB"), "pmid": ("last", "PMID"), "pmcid": ("last", "PMC"), "institution": (" ", "AD")},
}
#: How a line of each format begins a field, and the tag that begins a record (fixed values).
LINES = {"ris": (r"^([A-Za-z]{2})\s*-\s*(.*)$", "TY"), "enw": (r"^%(.)(.*)$", "0"), "pubmed_ris": (r"^([A-Za-z0-9]{2,})\s*-\s*(.*)$", "PMID"), "wos": (r"^([A-Z]{2})\s+(.*)$", None)}
SOURCE = {"ris": "cnki", "enw": "cnki", "pubmed": "pubmed", "pubmed_ris": "pubmed", "wos": "wos", "woscsv": "wos", "duxiu": "duxiu"}
#: Labels of the Chinese format, and the heads of an abstract and of what follows it (fixed values).
LABELS = {"title": r"题\s*名", "authors": r"作\s*者", "institution": "作者单位", "keywords": "关键词", "place": r"出\s*处", "abstract": r"摘\s*要", "url": r"链\s*接", "issn": "ISSN"}
TAIL = r"(?i)^(?:©|PMID:|DOI:|PMCID:|COPYRIGHT|CONFLICT OF INTEREST|KEYWORD|ELECTRONIC ADDRESS)"
HEADS = r"(?i)^(?:OBJECTIVE|BACKGROUND|INTRODUCTION|AIM|METHODS|RESULTS|CONCLUSION|DISCUSSION|IMPORTANCE|SUMMARY)[:：]"
_YEAR = r"(?:19|20)\d{2}"
_BREAK = "\r\n|\n|\r"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of every file of a folder, a byte order mark taken off."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("text"))


def reference_format(text: Column) -> Column:
    """The format that a piece of text looks like by one line; ``unknown`` for none."""
    return (
        F.when(text.rlike(r"(?m)^TY  - "), "ris").when(text.rlike(r"(?m)^%0 "), "enw").when(text.rlike(r"(?m)^PT J"), "wos").when(text.rlike(r"(?m)^PMID- "), "pubmed_ris").when(text.rlike(r"(?m)^\d+\. .+\. \d{4}"), "pubmed").otherwise("unknown")
    )


def detected_format(text: Column) -> Column:
    """Which of the seven formats a whole file's text is in, the first that fits; null for none."""
    first = F.trim(F.regexp_extract(text, r"(?m)^\s*(\S.*)$", 1))
    header = F.transform(F.split(F.upper(first), "[,\t;]"), lambda h: F.btrim(F.trim(h), F.lit('"')))
    wos = (F.contains(text, F.lit("PT J")) | F.contains(text, F.lit("PT S"))) & text.rlike(r"(?m)^ER\s*$")
    rules = [
        (text.rlike(r"(?m)^TY\s*-\s*") & text.rlike(r"(?m)^ER\s*-\s*"), "ris"), (text.rlike(r"(?m)^%0\s*"), "enw"), (wos, "wos"),
        (text.rlike(r"(?m)^\d+\.\s*\[") & text.rlike(r"题\s*名\s*[：:]|出\s*处\s*[：:]"), "duxiu"), (text.rlike(r"(?m)^PMID\s*-\s*\d+"), "pubmed_ris"),
        (F.contains(first, F.lit("PMID:")) | first.rlike(r"^\d+\.\s*\S"), "pubmed"), (F.array_contains(header, "TI"), "woscsv"),
    ]
    return reduce(lambda a, r: a.when(*r), rules[1:], F.when(*rules[0]))


def _clean_year(text: Column) -> Column:
    return F.regexp_replace(F.substr(text, F.lit(1), F.lit(4)), "[^0-9]", "")


def _in_year(text: Column) -> Column:
    return F.regexp_extract(text, _YEAR, 0)


def _before_year(text: Column) -> Column:
    """What a citation says before its year, without number and closing mark."""
    part = F.regexp_replace(F.regexp_extract(text, rf"(?s)^(.*?){_YEAR}", 1), r"^\d+\.\s*", "")
    return F.trim(F.regexp_replace(F.trim(F.split(F.trim(part), "doi:")[0]), r"[,.;]\s*$", ""))


def _record(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """All ``FIELDS`` of the records that have a title."""
    columns = [F.coalesce(fields[f], F.lit("")).alias(f) if f in fields else F.lit("").alias(f) for f in FIELDS]
    return rows.select("file", "record", *columns).where(F.length("title") > 0)


def read_tagged(files: DataFrame, form: str) -> DataFrame:
    """Records of one of the four formats of tagged lines."""
    pattern, start = LINES[form]
    lines = files.select("file", F.posexplode(F.split("text", _BREAK)).alias("i", "line")).where(F.trim("line") != "")
    tagged = F.col("line").rlike(pattern)
    tag, own = F.upper(F.regexp_extract("line", pattern, 1)), F.trim(F.regexp_extract("line", pattern, 2))
    so_far = W.partitionBy("file").orderBy("i")  # the lines of one file
    if form == "wos":  # records end with a line of their own; only an indented line continues one
        end = F.col("line").rlike(r"^ER\s*$")
        begun = F.when(F.col("line").rlike(r"^\s"), None).when(tagged & ~end, tag).otherwise("")
        number = F.sum(end.cast("int")).over(so_far)
    else:
        begun = F.when(tagged, tag)
        number = F.sum((F.coalesce(begun, F.lit("")) == start).cast("int")).over(so_far)
    rows = lines.select("file", "i", number.alias("record"), F.last(begun, ignorenulls=True).over(so_far).alias("tag"), F.when(begun.isNotNull(), own).otherwise(F.trim("line")).alias("content"))
    rows = rows.where((F.col("tag") != "") & (F.col("content") != "") & (F.lit(form == "wos") | (F.col("record") > 0)))
    records = rows.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("i", "tag", "content"))).alias("lines"))  # the lines of one record

    def of(*tags: str) -> Column:
        return F.transform(F.filter("lines", lambda x: x["tag"].isin(*tags)), lambda x: x["content"])

    fields = {}
    for name, (how, *tags) in TAGS[form].items():
        fields[name] = F.get(of(*tags), F.size(of(*tags)) - 1) if how == "last" else F.array_join(of(*tags), "; " if how == ";" else " ")
    fields["year"] = _clean_year(fields["pub_date"])
    if form == "enw":
        fields["doi"] = F.coalesce(fields["doi"], F.get(of("7"), 0))
    if form == "pubmed_ris":
        doi = F.filter(F.transform(of("LID", "AID"), lambda d: F.trim(F.regexp_replace(d, r"(?i)\s*\[doi\]", ""))), lambda d: F.startswith(d, F.lit("10.")))
        fields["doi"] = F.get(doi, F.size(doi) - 1)
        sources = F.filter(of("SO"), lambda s: s.rlike(_YEAR))
        fields["journal"] = F.coalesce(fields["journal"], F.get(of("TA"), 0), F.rtrim(F.trim(F.regexp_extract(F.get(sources, 0), rf"^(.*?){_YEAR}", 1)), F.lit(".")))
        dated = F.filter(of("DP"), lambda d: d.rlike(_YEAR))
        fields["year"] = _in_year(F.get(dated, F.size(dated) - 1))
        fields["url"] = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), fields["pmid"], F.lit("/"))
    return _record(records, fields | {"source": F.lit(SOURCE[form])})


def _numbered(files: DataFrame, head: str, consecutive: bool, **parts: Callable[[Column], Column]) -> DataFrame:
    """``file, record, text`` and columns of its ``parts``: a file cut at the lines that begin with ``head``; if ``consecutive``, at those whose number follows the last one's.

    Records are cut inside the generator: a text and its parts are computed once, whatever reads them, and no record carries the file's lines.
    """
    lines = F.split("text", _BREAK)
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, head, 1).try_cast("int").alias("n"))), lambda h: h["n"].isNotNull())
    if consecutive:
        empty = F.struct(F.lit(None).cast("int").alias("n"), F.array().cast("array<int>").alias("at"))
        follow = lambda a, h: F.when(a["n"].isNull() | (h["n"] == a["n"] + 1), F.struct(h["n"].alias("n"), F.concat(a["at"], F.array(h["i"])).alias("at"))).otherwise(a)
        starts = F.aggregate(heads, empty, follow)["at"]
    else:
        starts = F.transform(heads, lambda h: h["i"])
    rows = files.select("file", lines.alias("lines"), starts.alias("starts"))
    texts = F.transform("starts", lambda at, r: F.array_join(F.slice("lines", at + 1, F.coalesce(F.get("starts", r + 1), F.size("lines")) - at), "\n"))
    cut = F.transform(texts, lambda t: F.struct(t.alias("text"), *[of(t).alias(name) for name, of in parts.items()]))
    return rows.select("file", F.posexplode(cut).alias("record", "r")).select("file", "record", "r.*")


def read_duxiu(files: DataFrame) -> DataFrame:
    rows = _numbered(files, r"^(\d+)\.\s*\[", consecutive=False)
    said = {f: F.trim(F.regexp_replace(F.regexp_extract("text", rf"(?m)^{label}\s*[：:]\s*(.*)$", 1), r"\s+", " ")) for f, label in LABELS.items()}
    parts = F.filter(F.transform(F.split(said.pop("place"), ";"), lambda p: F.trim(p)), lambda p: p != "")
    years = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), _in_year), lambda y: y != "")
    return _record(rows, said | {"journal": F.get(parts, 0), "year": F.get(years, 0), "source": F.lit("duxiu")})


def read_pubmed(files: DataFrame) -> DataFrame:
    """Numbered abstracts: a citation, title and authors in paragraphs of their own, or the short style of one paragraph."""
    filled = lambda parts, trim: F.filter(F.transform(parts, trim), lambda x: x != "")
    blocks = lambda t: filled(F.split(F.trim(t), r"\n\s*\n"), lambda b: F.btrim(b, F.lit(" \t\r\n")))
    rows = _numbered(files, r"^(\d{1,4})\.\s", consecutive=True, b=blocks, l=lambda t: filled(F.split(t, "\n"), lambda x: F.trim(x)))
    text = F.col("text")
    flat = lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))
    block, line, year = (lambda i: F.get("b", i)), (lambda i: F.get("l", i)), _in_year(text)
    numberless = lambda t: F.regexp_replace(t, r"^\d+\.\s*", "")
    cited = block(0).rlike(r"(?i)doi:\s*\S+") | block(0).rlike(rf"\.\s*{_YEAR}")

    def to_tail(skip: int) -> Column:
        """Paragraphs from ``skip`` on up to the first one of the tail."""
        rest = F.slice("b", skip + 1, F.greatest(F.size("b"), F.lit(1)))
        tail = F.array_position(F.transform(rest, lambda b: b.rlike(TAIL)), True)
        return F.when(tail > 0, F.slice(rest, 1, (tail - 1).cast("int"))).otherwise(rest)

    body = to_tail(3)
    first = F.array_position(F.transform(body, lambda b: ~F.startswith(F.upper(b), F.lit("AUTHOR INFORMATION"))), True)
    body = F.when(first > 0, F.slice(body, first.cast("int"), F.greatest(F.size(body), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    # one paragraph: the lines after an abstract's head; a line of PMID or DOI begins anew
    step = lambda a, x: F.when(x.rlike("(?i)^(?:PMID|DOI):"), F.array().cast("array<string>")).when((F.size(a) > 0) | x.rlike(HEADS), F.concat(a, F.array(x))).otherwise(a)
    short = F.aggregate("l", F.array().cast("array<string>"), step)
    one = F.size("b") == 1
    with_year = lambda parts: _before_year(F.get(F.filter(parts, lambda x: F.contains(x, year)), 0))
    joined = lambda parts: F.array_join(F.transform(parts, flat), " ")
    dated = flat(F.regexp_extract(text, rf"(?i)\b({_YEAR}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*(?:\s+\d{{1,2}})?)", 1))
    pmid = F.regexp_extract(text, r"(?i)PMID:\s*(\d+)", 1)
    strip = lambda t: F.rtrim(t, F.lit(".,;"))
    fields = {
        "title": F.when(one, numberless(line(0))).when(cited, flat(block(1))).otherwise(F.trim(numberless(block(0)))),
        "authors": F.when(one, line(1)).when(cited, F.rtrim(flat(block(2)), F.lit("."))).otherwise(flat(block(1))),
        "journal": F.when(year == "", "").when(one, with_year("l")).when(cited, _before_year(block(0))).otherwise(with_year("b")),
        "abstract": F.when(one, F.array_join(short, " ")).when(cited, joined(body)).otherwise(joined(to_tail(2))),
        "year": year, "pub_date": F.when(dated != "", dated).otherwise(year), "pmid": pmid,
        "doi": strip(F.regexp_extract(text, r"(?i)DOI:\s*(\S+)", 1)), "pmcid": strip(F.regexp_extract(text, r"(?i)PMCID:\s*(\S+)", 1)),
        "keywords": flat(F.regexp_extract(text, r"(?mi)^Keywords?[:：]\s*(.+)$", 1)),
        "url": F.when(pmid != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))), "source": F.lit("pubmed"),
    }
    return _record(rows, fields)


def _table_rows(texts: pd.Series) -> pd.Series:
    """Rows of a delimited text as maps by upper-case header; the delimiter is sniffed."""
    out = []
    for text in texts:
        try:
            dialect = csv.Sniffer().sniff(text[:4096], delimiters=",\t;")
            dialect.doublequote = True  # two quotes are one, whatever the sample shows
        except csv.Error:
            dialect = csv.excel
        rows = csv.DictReader(io.StringIO(text, newline=""), dialect=dialect)
        out.append([{(k or "").strip().upper(): (v or "").strip() for k, v in r.items() if isinstance(v, str)} for r in rows])
    return pd.Series(out)


def read_woscsv(files: DataFrame) -> DataFrame:
    """Delimited tables with a header of tags; a file is one table."""
    rows = files.select("file", F.posexplode(F.pandas_udf(_table_rows, "array<map<string,string>>")("text")).alias("record", "row"))
    fields = {name: F.element_at("row", F.lit(tags[0])) for name, (_, *tags) in TAGS["wos"].items()}
    return _record(rows, fields | {"year": _clean_year(fields["pub_date"]), "source": F.lit("wos")})


def parse_references(files: DataFrame, form: str = "auto") -> DataFrame:
    """``format`` and the records of all files; unless ``form`` names it, each file's format is detected, ``ris`` where none fits.

    Texts and formats are computed once, into a table with a folder for each format; a reader reads its own.
    """
    readers = {"pubmed": read_pubmed, "duxiu": read_duxiu, "woscsv": read_woscsv, **{f: (lambda rows, f=f: read_tagged(rows, f)) for f in LINES}}
    names = [name for name in readers if form in ("auto", name)]
    if not names:
        raise ValueError(f"unknown format: {form}")
    rows = files.select("file", "text", (F.coalesce(detected_format(F.col("text")), F.lit("ris")) if form == "auto" else F.lit(form)).alias("format"))
    # blank files go after the table: before it, the filter would compute each text again
    files = Tables(files.sparkSession, "references").write(rows, "format").where(F.length(F.trim("text")) > 0)
    parts = [readers[name](files.where(F.col("format") == name)).withColumn("format", F.lit(name)) for name in names]
    return reduce(DataFrame.unionByName, parts)


def read_references(spark: SparkSession, path: str, form: str = "auto") -> DataFrame:
    return parse_references(read_files(spark, path), form)


def write_ris(records: DataFrame, path: str) -> None:
    """One text file for each partition, a record for each row; ``read_references`` reads them back."""
    def line(tag: str, field: str) -> Column:
        return F.when(F.length(field) > 0, F.concat(F.lit(f"{tag}  - "), F.regexp_replace(field, r"\s+", " ")))

    def each(tag: str, field: str) -> Column:
        values = F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), ";"), lambda v: F.trim(v)), lambda v: v != "")
        return F.array_join(F.transform(values, lambda v: F.concat(F.lit(f"{tag}  - "), v)), "\n")

    parts = [F.lit("TY  - JOUR"), line("TI", "title"), F.nullif(each("AU", "authors"), F.lit("")), line("JO", "journal"), line("PY", "year"), line("DO", "doi"), line("AB", "abstract"), F.nullif(each("KW", "keywords"), F.lit("")), F.lit("ER  - \n")]
    records.select(F.concat_ws("\n", *parts).alias("value")).write.text(path)


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of RIS files, older tags too: title, authors, year, doi, journal."""
    files = spark.read.text(path, wholetext=True)
    records = files.select(F.explode(F.split("value", r"(?m)^ER  -.*$")).alias("record")).where(F.col("record").rlike(r"(?m)^TY  - "))

    def first(tags: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("record", rf"(?m)^(?:{tags})  - (.*)$", 1)), F.lit(""))

    return records.select(
        first("TI|T1").alias("title"),
        F.array_join(F.regexp_extract_all("record", F.lit(r"(?m)^(?:AU|A1)  - (.*)$"), 1), "; ").alias("authors"),
        F.try_to_number(F.regexp_extract("record", r"(?m)^(?:PY|Y1)  - (\d{4})", 1), F.lit("9999")).cast("int").alias("pub_year"),
        F.lower(first("DO")).alias("doi"),
        first("JO|JF|T2").alias("journal"),
    )


def import_records(known: DataFrame, found: DataFrame) -> DataFrame:
    """Records that are new by DOI, or by exact title where they have none."""
    by_doi = found.where(F.col("doi").isNotNull()).join(known.select(F.lower("doi").alias("doi")).where("doi is not null"), "doi", "left_anti")
    by_title = found.where(F.col("doi").isNull()).join(known.select("title"), "title", "left_anti")
    return by_doi.unionByName(by_title)


def export_rows(frame: DataFrame, path: str, form: str = "csv") -> None:
    """CSV with a header, or JSON lines; one folder of part files."""
    (frame.write.option("header", True).csv(path) if form == "csv" else frame.write.json(path))
