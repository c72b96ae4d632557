"""Where a text holds the passage that an extracted fact cites: whole, trimmed, nearly, or by its key phrases.

Offsets count characters of the text without white space, start included, end excluded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters cut from a passage, and the offset of what is left, in the order in which they are tried.
TRIMS = ((0, 0), (2, 0), (2, 2), (4, 0), (4, 2), (4, 4))


def squeezed(text: Column) -> Column:
    """Without white space, with straight quotes; null is empty."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}\x{85}\x1C-\x1F]+", ""), "“”‘’", "\"\"''")


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def located(text: Column, passage: Column) -> Column:
    """Span of a passage of four characters or more in a text, both squeezed; else of the passage with trimmed edges, else null.

    A trimmed passage counts with its whole length from where the trimmed part starts.
    """
    n = F.length(passage)
    tries = []
    for cut, skip in TRIMS:
        width = F.greatest(F.lit(4), n - cut)
        tries.append(F.when(F.lit(skip) <= n - width, F.instr(text, F.substr(passage, F.lit(skip + 1), width))))
    first = F.coalesce(*[F.nullif(t, F.lit(0)) for t in tries]) - 1
    return F.when((n >= 4) & first.isNotNull(), _span(first, F.least(first + n, F.length(text))))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table held in the bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _covered(text: str, part: str, starts: range, window: int) -> list[int]:
    """``lcs_length`` of the part and each window of the text. A part of up to 64 characters takes one step for each place in the windows, for all windows at once."""
    if len(part) > 64:
        return [lcs_length(text[i : i + window], part) for i in starts]
    wanted, spots = np.unique(_codes(part), return_inverse=True)
    masks = np.zeros(len(wanted) + 1, np.uint64)  # the last one is of characters that the part lacks
    for i, c in enumerate(spots):
        masks[c] |= np.uint64(1 << i)
    own = _codes(text)
    at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
    own = masks[np.where(wanted[at] == own, at, len(wanted))] if len(own) else np.zeros(0, np.uint64)
    row = np.full(len(starts), ~np.uint64(0))
    for k in range(window):
        hit = row & own[k :: starts.step][: len(starts)]
        row = row + hit | row & ~hit
    return (len(part) - np.bitwise_count(row & np.uint64((1 << len(part)) - 1)).astype(int)).tolist()


def nearest_window(text: str | None, passage: str | None, least: float) -> tuple[int, int] | None:
    """The first window that covers most of the passage (its first 200 characters) as a subsequence, if ``least`` of it."""
    if text is None or passage is None or len(passage) < 6:
        return None
    part = passage[:200]
    window, step = min(len(text), len(part) + 20), max(1, len(part) // 3)
    starts = range(0, max(1, len(text) - window + 1), step)
    covered = _covered(text, part, starts, window)
    best = max(range(len(covered)), key=covered.__getitem__)
    return (starts[best], starts[best] + window) if covered[best] >= least * len(part) and covered[best] else None


def near(text: Column, passage: Column, least: float) -> Column:
    """``nearest_window`` in Arrow batches; a null text costs nothing."""

    @F.pandas_udf("start int, end int")
    def windows(texts: pd.Series, passages: pd.Series) -> pd.DataFrame:
        spans = [nearest_window(t, p, least) or (None, None) for t, p in zip(texts, passages, strict=True)]
        return pd.DataFrame(spans, columns=["start", "end"]).astype("Int32")

    found = windows(text, passage)
    return F.when(found["start"].isNotNull(), _span(found["start"], found["end"]))


def by_phrases(text: Column, phrases: Column) -> Column:
    """Span of the first places of the eight longest phrases, where two or more occur within 800 characters, with some context."""
    wanted = F.array_distinct(F.filter(F.transform(phrases, lambda p: F.trim(p)), lambda p: F.length(p) > 0))
    longest = F.slice(F.array_sort(F.transform(wanted, lambda p: F.struct((-F.length(p)).alias("k"), p.alias("p")))), 1, 8)
    spots = F.transform(longest, lambda x: _span(F.instr(text, x["p"]) - 1, F.instr(text, x["p"]) - 1 + F.length(x["p"])))
    spots = F.filter(spots, lambda x: x["start"] >= 0)
    low, high = F.array_min(F.transform(spots, lambda x: x["start"])), F.array_max(F.transform(spots, lambda x: x["end"]))
    return F.when((F.size(spots) >= 2) & (high - low <= 800), _span(F.greatest(low - 10, F.lit(0)), F.least(high + 30, F.length(text))))


def numbers_found(text: Column, passage: Column, numbers: Column) -> Column:
    """Whether every number that isn't null is written in the text or the passage, whole ones without a decimal point.

    Numbers are looked up as people write them, never with an exponent.
    """
    plain = lambda v: F.regexp_replace(v.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    whole = lambda v: v.cast("decimal(38,0)").cast("string")
    written = F.transform(F.filter(numbers, lambda v: v.isNotNull()), lambda v: F.when(v == F.rint(v), whole(v)).otherwise(plain(v)))
    return F.forall(written, lambda s: F.contains(F.coalesce(text, F.lit("")), s) | F.contains(F.coalesce(passage, F.lit("")), s))


def ground(rows: DataFrame, text: str, passage: str, phrases: Column, numbers: Column, least: float = 0.72) -> DataFrame:
    """``method``, ``start``, ``end`` of each row's passage (exact, fuzzy, keyphrase or null), and ``grounded``.

    Only rows whose passage isn't found exactly send their text to Python. A row is grounded if it was found and all its
    numbers are in the text.
    """
    out = rows.withColumns({"__text": squeezed(F.col(text)), "__passage": squeezed(F.col(passage))})
    out = out.withColumn("__exact", located(F.col("__text"), F.col("__passage")))
    missing = F.when(F.col("__exact").isNull() & (F.length("__text") > 0), F.col("__text"))
    out = out.withColumn("__near", near(missing, F.col("__passage"), least))
    out = out.withColumn("__phrase", F.when(F.col("__exact").isNull() & F.col("__near").isNull(), by_phrases(F.col("__text"), phrases)))
    span = F.coalesce("__exact", "__near", "__phrase")
    method = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__near").isNotNull(), "fuzzy").when(F.col("__phrase").isNotNull(), "keyphrase")
    grounded = span.isNotNull() & numbers_found(F.col(text), F.col(passage), numbers)
    return out.select(*rows.columns, method.alias("method"), span["start"].alias("start"), span["end"].alias("end"), grounded.alias("grounded"))
