"""Titles out of file names, and their repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings, year prefixes (several may follow each other), copy marks, and what is stripped at the ends (fixed values).
ENDINGS = r"(?i)\.(?:pdf|caj|doc|docx|txt|epub|pptx|xlsx|ps|wps|md)$"
YEARS = r"^(?:(?:(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:19|20)\d{2})\s*[ _\-.,;:]\s*)+"
COPIES = r"\s*\([0-9]+\)\s*$|_副本\s*$"
EDGES = " ._-,;:"
_HAN = r"\x{4E00}-\x{9FFF}"


def from_file_name(name: Column) -> Column:
    """The title in a file's name: without path, ending, copy mark and years before it; the name itself if nothing is left."""
    t = F.element_at(F.split(F.replace(F.trim(name), F.lit("\\"), F.lit("/")), "/"), -1)
    t = F.trim(F.regexp_replace(t, ENDINGS, ""))
    t = F.trim(F.regexp_replace(t, COPIES, ""))
    t = F.btrim(F.regexp_replace(t, YEARS, ""), F.lit(EDGES))
    return F.when(F.length(t) > 0, t).otherwise(name)


def repaired(title: Column) -> Column:
    """``from_file_name``, without authors of two to four Chinese characters at the end, and with slashes between Chinese characters for underscores."""
    t = F.trim(F.regexp_replace(from_file_name(title), rf"(?:_[{_HAN}]{{2,4}}\s*)+$", ""))
    # a second pass takes the pairs that share a character with the first
    for _ in range(2):
        t = F.regexp_replace(t, rf"([{_HAN}])_([{_HAN}])", "$1/$2")
    t = F.btrim(t, F.lit(EDGES))
    return F.when(F.length(t) > 0, t).otherwise(title)
