"""Column functions that read values out of free text, and names into their standard forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing titer, and separators of multi-valued fields (fixed values).
MISSING = ("", "-", "—", "–", "/", "·", "NA", "n/a", "N/A", "null", "None", "nan")
SEPARATORS = "[;,；、，]"
#: File name endings and URL starts with the format they stand for, in the order in which they are tried (fixed values).
FORMATS = (
    ("%.pdf", "PDF"), ("%.caj", "CAJ"), ("%.epub", "EPUB"), ("%.docx", "DOCX"), ("%.pptx", "PPTX"), ("%.xlsx", "XLSX"), ("%.txt", "TXT"), ("%.htm", "HTML"),
    ("http://%", "URL"), ("https://%", "URL"),
)
_NUMBER = r"-?\d+(?:\.\d+)?"


def tolerant_float(text: Column) -> Column:
    """The first number of a text; thousands separators are dropped, null where there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, "[,，%％]", ""), _NUMBER, 0), F.lit("")).cast("double")


def interval(text: Column) -> tuple[Column, Column]:
    """Least and largest of the last two numbers, once the level (95 or 90 percent) is taken out."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)9[05]\s*%?\s*(CI)?", ""), "[%％]", "")
    last = F.slice(F.transform(F.regexp_extract_all(bare, F.lit(f"({_NUMBER})"), 1), lambda n: n.cast("double")), -2, 2)
    two = F.size(last) == 2
    return F.when(two, F.array_min(last)), F.when(two, F.array_max(last))


def titer_cell(text: Column) -> Column:
    """A titer; below the limit of detection (``<10``) is 0, a mark of absence null."""
    s = F.replace(F.replace(F.trim(text), F.lit("，"), F.lit(",")), F.lit("："), F.lit(":"))
    return F.when(s.isin(*MISSING), None).when(s.rlike(r"^[<≤]\s*[0-9.]+$"), 0.0).otherwise(s.try_cast("double"))


def split_multi(value: Column) -> Column:
    """The values of a multi-valued field, without blank ones; null gives none."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), SEPARATORS), lambda v: F.trim(v))
    return F.filter(parts, lambda v: v != "")


def file_format(path: Column) -> Column:
    """The format of a file by its name; ``.html`` is none of the endings known."""
    out = reduce(lambda a, f: a.when(F.lower(path).like(f[0]), f[1]), FORMATS[1:], F.when(F.lower(path).like(FORMATS[0][0]), FORMATS[0][1]))
    return out


def review_state(extracted: Column, approved: Column) -> Column:
    return F.when(extracted == 0, "none").when(approved == 0, "pending").when(approved < extracted, "partial").when(approved == extracted, "approved")


def alias_by_longest(name: Column, aliases: dict[str, str]) -> Column:
    """Standard name: exact, else in any case, else that of the longest alias (two characters or more) held by the name.

    A blank name is null, an unknown one stays. The aliases are a dictionary of names, so they go into the plan.
    """
    n = F.trim(name)
    low = F.lower(n)

    def table(pairs: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")

    folded: dict[str, str] = {}
    for key, value in aliases.items():
        folded.setdefault(key.lower(), value)
    longest = sorted((k for k in aliases if len(k) >= 2), key=lambda k: -len(k))
    held = F.filter(F.array(*[F.lit(k) for k in longest]).cast("array<string>"), lambda k: F.contains(low, F.lower(k)))
    return F.when(F.length(name) > 0, F.coalesce(F.try_element_at(table(aliases), n), F.try_element_at(table(folded), low), F.try_element_at(table(aliases), F.get(held, 0)), n))


def alias_by_first(name: Column, aliases: dict[str, str], fold: bool = False) -> Column:
    """Standard name: exact, else that of the first alias that holds the name or is held by it, in any case if ``fold``; an unknown name stays."""
    n = F.trim(name)
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])

    def near(seen: Column) -> Column:
        """Branches stop at the first alias that fits."""
        fits = [(F.lower(F.lit(k)) if fold else F.lit(k), v) for k, v in aliases.items()]
        (k, v), *rest = fits
        return reduce(lambda a, p: a.when(F.contains(seen, p[0]) | F.contains(p[0], seen), p[1]), rest, F.when(F.contains(seen, k) | F.contains(k, seen), v))

    found = F.get(F.transform(F.array(F.lower(n) if fold else n), near), 0)  # one element, so that the name is trimmed and folded once
    return F.when(F.length(name) > 0, F.coalesce(F.try_element_at(table, n), found, n))
