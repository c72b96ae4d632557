"""Text and scoring Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titerlake.functions.parsing import split_multi


def normal_title(title: Column) -> Column:
    t = F.regexp_replace(F.lower(title), r"[-_–—]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def surname(authors: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(F.element_at(F.split(authors, "[;,]"), 1)), r"\s+"), -1))


def clean(text: Column) -> Column:
    """Control characters out, runs of blanks and of empty lines squeezed."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def language_vote(text: Column) -> Column:
    cjk, latin = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(cjk > latin, "zh").otherwise("en")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def score_sample_size(n: Column) -> Column:
    return F.when(n >= 2001, 30).when(n >= 500, 24).when(n >= 100, 16).when(n >= 1, 8).otherwise(0)


#: Words of a sampling design and of a population that count for its score (fixed values; case counts).
SAMPLED_WELL = r"随机|多阶段|分层整群|分层抽樣|probability\s*sampling|multi[- ]stage|stratified|cluster\s*sampling"
SAMPLED_POORLY = "便利|convenience"
PEOPLE_AT_LARGE = "general|全人群|一般人群|社区|school[- ]based|在校|学生"
PEOPLE_IN_CARE = "门诊|医院|hospital|患者|病例"


def score_sampling(text: Column) -> Column:
    return F.when(text.rlike(SAMPLED_WELL), 25).when(text.rlike(SAMPLED_POORLY), 6).otherwise(12)


def score_method(method: Column, known: list[str]) -> Column:
    """15 for a known method (in any case), 8 for another, 0 for none."""
    m = F.trim(method)
    return F.when(F.coalesce(m, F.lit("")) == "", 0).when(F.upper(m).isin(*[k.upper() for k in known]), 15).otherwise(8)


def score_population(population: Column) -> Column:
    return F.when(population.rlike(PEOPLE_AT_LARGE), 15).when(population.rlike(PEOPLE_IN_CARE), 5).otherwise(8)


def survey_level(province: Column, city: Column, n: Column) -> Column:
    """national with ten provinces or more; provincial with one of several cities, or of a large sample; else local."""
    provinces, cities = F.size(split_multi(province)), F.size(split_multi(city))
    return F.when(provinces >= 10, "national").when((provinces == 1) & (cities >= 2), "provincial").when((provinces >= 1) & (n >= 2000), "provincial").otherwise("local")


def score_level(level: Column) -> Column:
    return F.when(level == "national", 10).when(level == "provincial", 8).otherwise(5)


def score_confidence(c: Column) -> Column:
    level = F.lower(F.trim(c))
    return F.when(level == "high", 5).when(level == "medium", 3).otherwise(1)


def grade(score: Column) -> Column:
    return F.when(score >= 75, "A").when(score >= 50, "B").otherwise("C")


def reliability(n: Column, has_ci: Column, confidence: Column, grounded: Column, studies: Column) -> Column:
    """Grade from five signals of at most 12 points."""
    points = F.when(n >= 1000, 3).when(n >= 200, 2).when(n >= 50, 1).otherwise(0)
    points = points + F.when(has_ci, 2).otherwise(0) + F.when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1)
    points = points + F.when(grounded, 2).otherwise(0) + F.when(studies >= 5, 2).when(studies >= 2, 1).otherwise(0)
    return F.when(points >= 9, "A").when(points >= 6, "B").when(points >= 4, "C").otherwise("D")


def age_label(low: Column, high: Column) -> Column:
    both = F.concat(low.cast("string"), F.lit("-"), high.cast("string"))
    return F.when(low.isNotNull() & high.isNotNull(), both).when(low.isNotNull(), F.concat(low.cast("string"), F.lit("+"))).when(high.isNotNull(), F.concat(F.lit("<="), high.cast("string")))


def chunks(docs: DataFrame, threshold: int = 20000, size: int = 15000) -> DataFrame:
    """``doc_id, chunk, part``: texts over the threshold in parts of ``size`` characters, others whole; null is empty."""
    text = F.coalesce("text", F.lit(""))
    width = F.when(F.length(text) > threshold, size).otherwise(threshold)
    last = F.greatest(F.ceil(F.length(text) / width), F.lit(1)) - 1
    each = docs.select("doc_id", text.alias("text"), width.alias("width"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return each.select("doc_id", "chunk", F.substr("text", (F.col("chunk") * F.col("width") + 1).cast("int"), F.col("width")).alias("part"))


def truncated(text: Column, most: int = 60000) -> Column:
    """At most so many characters, cut at the last line end if that lies in the last 30 percent."""
    head = F.substr(text, F.lit(1), F.lit(most))
    last = F.length(head) - F.instr(F.reverse(head), "\n")
    at_line = F.contains(head, F.lit("\n")) & (last > 0.7 * most)
    return F.when(F.length(text) <= most, text).when(at_line, F.substr(head, F.lit(1), last)).otherwise(head)


def reference_list(text: Column) -> Column:
    """The numbered lines after the heading of the references, trimmed; none without a heading."""
    after = F.regexp_extract(text, r"(?is)(?:参考文献|References)\s*\n(.*)", 1)
    return F.filter(F.transform(F.split(after, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[\[(]?\d+[\]).]"))


def focused(text: Column, words: list[str], most_chars: int = 5000, least_lines: int = 80, opening: int = 20) -> Column:
    """The two thirds of a long text's lines (or ``least_lines``) that hold most of the words, in their order.

    Each of the ``opening`` lines scores one more; of equal scores the earlier line stays.
    """
    lines = F.split(text, "\n")
    hits = lambda x: sum((F.contains(F.lower(x), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    scored = F.transform(lines, lambda x, i: F.struct((-hits(x) - F.when(i < opening, 1).otherwise(0)).alias("s"), i.alias("i"), x.alias("x")))
    keep = F.greatest(F.lit(least_lines), F.floor(F.size(lines) * 2 / 3).cast("int"))
    kept = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, keep), lambda r: F.struct(r["i"], r["x"])))
    return F.when(F.length(text) <= most_chars, text).otherwise(F.array_join(F.transform(kept, lambda r: r["x"]), "\n"))


def table_rows(markdown: Column) -> Column:
    """Data rows of the tables in a Markdown text: lines that start with a bar, less two for each line of dashes."""
    bars = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")))
    rules = F.filter(bars, lambda x: x.rlike(r"^\|[\s\-:|]+\|?\s*$"))
    return F.greatest(F.size(bars) - 2 * F.size(rules), F.lit(0))


def listed_price(name: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Prices (in, out) a million, as decimals, of the first entry whose key a name holds; null for an unknown one."""
    out = None
    for key, (inward, outward) in prices.items():
        price = F.struct(*[F.lit(str(v)).cast("decimal(10,4)").alias(k) for k, v in (("inward", inward), ("outward", outward))])
        held = F.contains(F.lower(name), F.lit(key))
        out = F.when(held, price) if out is None else out.when(held, price)
    return out
