"""Columns on spans of text: tables, chunks, windows, places in the raw text, marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of a chunk, the best first (fixed values).
SEPARATORS = ("\n\n", "\n", "。", "；", ". ", "; ")
_BLANK = r"\s\p{Z}\x{85}\x1C-\x1F"
SPAN = "struct<start:int,end:int>"


def table_spans(text: Column) -> Column:
    """Spans of the Markdown tables of a text: runs of lines that begin with a bar, the last line end included."""
    table = r"(?m)^\|[^\n]*(?:\n\|[^\n]*)*(?:\n|\z)"
    tables = F.regexp_extract_all(text, F.lit(f"({table})"), 1)
    between = F.split(text, table)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(a: Column, i: Column) -> Column:
        start = a["at"] + F.length(F.get(between, i))
        end = start + F.length(F.get(tables, i))
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    places = F.when(F.size(tables) > 0, F.sequence(F.lit(0), F.size(tables) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNotNull(), F.aggregate(places, zero, step)["spans"])


def _last(text: Column, mark: str, low: Column, high: Column) -> Column:
    """Where the last ``mark`` between two places ends; null where there is none."""
    part = F.substr(text, low + 1, F.greatest(high - low, F.lit(0)))
    back = F.instr(F.reverse(part), mark[::-1])
    return F.when(back > 0, low + F.length(part) - back + 1)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def chunk_spans(text: Column, size: int = 15000, slack: int = 500, tables: Column | None = None) -> Column:
    """Spans of a text's chunks, one after another: at most ``size`` characters, cut at the best separator of the last ``slack``.

    A cut inside a table goes to its end if the chunk stays under 1.5 times ``size``, else to its start; only a table that
    is longer than that by itself is cut. Chunks without a word are left out. ``tables`` are spans, by default those of
    ``table_spans``.
    """
    n = F.length(text)

    def holding(tables: Column, place: Column) -> Column:
        """The table that holds a place after its first character."""
        return F.get(F.filter(tables, lambda t: (t["start"] < place) & (place < t["end"])), 0)

    def cut_at(tables: Column, start: Column, full: Column, held: Column) -> Column:
        limit = F.when(held["start"] > start, held["start"]).otherwise(full)
        cut = F.coalesce(*[_last(text, s, F.greatest(start + size - slack, start), limit) for s in SEPARATORS], limit)
        return _let(cut, lambda c: F.coalesce(F.get(F.filter(tables, lambda t: (t["start"] < c) & (c < t["end"]) & (t["start"] > start)), 0)["start"], c))

    def end_of(tables: Column, start: Column) -> Column:
        full = F.least(start + size, n)

        def unless_whole(held: Column) -> Column:
            return F.when(held["end"] - start < 1.5 * size, held["end"]).otherwise(cut_at(tables, start, full, held))

        return F.when(full >= n, n).otherwise(_let(holding(tables, full), unless_whole))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def spans(tables: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            more = _let(end_of(tables, a["at"]), lambda end: F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), end.alias("end")))).alias("spans")))
            return F.when(a["at"] < n, more).otherwise(a)

        # each chunk is longer than size - slack, but for those that end at a table
        most = F.ceil(n / (size - slack)).cast("int") + 2 * F.size(tables) + 1
        return F.aggregate(F.sequence(F.lit(1), most), zero, step)["spans"]

    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")).cast(SPAN))
    cut = F.when(n <= size, whole).otherwise(_let(table_spans(text) if tables is None else tables, spans))
    return F.filter(cut, lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"]).rlike(rf"[^{_BLANK}]") | (n <= size))


def raw_place(text: Column, place: Column) -> Column:
    """Where the character of a place in the text without white space stands in the text itself; null beyond its end.

    It is looked for in an opening of twice its place first, and in the whole text only if that has too few characters.
    """
    zero = F.struct(F.lit(0).alias("raw"), F.lit(0).alias("solid"), F.lit(None).cast("int").alias("found"))

    def step(a: Column, token: Column) -> Column:
        long = F.length(token)
        own = F.length(F.regexp_replace(token, f"^[{_BLANK}]+", ""))
        here = F.when(a["found"].isNull() & (place < a["solid"] + own), a["raw"] + long - own + place - a["solid"])
        return F.struct((a["raw"] + long).alias("raw"), (a["solid"] + own).alias("solid"), F.coalesce(a["found"], here).cast("int").alias("found"))

    def within(part: Column) -> Column:
        tokens = F.regexp_extract_all(part, F.lit(f"([{_BLANK}]*[^{_BLANK}]+)"), 1)
        return F.aggregate(tokens, zero, step)["found"]

    opening = F.substr(text, F.lit(1), (2 * place + 64).cast("int"))
    return F.when(place >= 0, F.coalesce(within(opening), F.when(F.length(text) > F.length(opening), within(text))))


def raw_span(text: Column, span: Column) -> Column:
    """A span of the text without white space as one of the text itself, from its first to its last character."""
    first, last = raw_place(text, span["start"]), raw_place(text, span["end"] - 1)
    return F.when(span.isNotNull() & first.isNotNull() & last.isNotNull(), F.struct(first.alias("start"), (last + 1).alias("end")))


def window(text: Column, span: Column, around: int = 200) -> Column:
    """What stands around a span: ``start``, ``end`` and ``snippet``, and the span's own end within the text."""
    n = F.length(text)
    low, high = F.greatest(span["start"] - around, F.lit(0)), F.least(span["end"] + around, n)
    made = F.struct(low.alias("start"), high.alias("end"), F.substr(text, low + 1, high - low).alias("snippet"), F.least(span["end"], n).alias("marked_end"))
    return F.when(text.isNotNull() & span.isNotNull(), made)


def escaped(text: Column) -> Column:
    """A text as it stands in HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def marked(text: Column, marks: Column) -> Column:
    """A text in HTML with ``marks`` (structs of start, end, id, confidence, grounded) around their spans.

    Marks go by start, the longer first; the part of one that an earlier mark covers is cut off, and one that is covered
    whole, or lies outside the text, is left out.
    """
    n = F.length(text)
    inside = F.filter(marks, lambda m: (m["start"] >= 0) & (m["end"] > m["start"]) & (m["start"] < n))
    order = F.array_sort(F.transform(inside, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("minus"), m["id"].cast("string").alias("id"), m["confidence"].alias("confidence"), m["grounded"].alias("grounded"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))

    def cut(low: Column, high: Column) -> Column:
        return escaped(F.substr(text, low + 1, high - low))

    def step(a: Column, m: Column) -> Column:
        start, end = F.greatest(m["start"], a["at"]), F.least(-m["minus"], n)
        level = F.coalesce(F.lower(m["confidence"]), F.lit("medium"))
        border = F.when(m["grounded"], "solid").otherwise("dashed")
        open_ = F.concat(F.lit('<mark id="hl-'), escaped(m["id"]), F.lit('" data-confidence="'), escaped(level), F.lit('" style="border-style:'), border, F.lit('">'))
        made = F.struct(end.alias("at"), F.concat(a["html"], cut(a["at"], start), open_, cut(start, end), F.lit("</mark>")).alias("html"))
        return F.when(start < end, made).otherwise(a)

    done = F.aggregate(order, zero, step)
    return F.concat(done["html"], cut(done["at"], n))


def trace_page(title: Column, text: Column, marks: Column, cards: Column) -> Column:
    """A page by itself: the marked text, and a list of cards (structs of id and summary) that lead to their marks."""
    listed = F.array_join(F.transform(cards, lambda c: F.concat(F.lit('<li><a href="#hl-'), escaped(c["id"].cast("string")), F.lit('">'), escaped(c["summary"]), F.lit("</a></li>"))), "\n")
    count = F.size(F.filter(marks, lambda m: m["grounded"])).cast("string")
    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="UTF-8"><title>'), escaped(title), F.lit("</title></head>\n<body><h1>"), escaped(title), F.lit("</h1>\n"))
    side = F.concat(F.lit("<aside><p>"), count, F.lit(" / "), F.size(marks).cast("string"), F.lit("</p>\n<ul>\n"), listed, F.lit("\n</ul></aside>\n"))
    return F.concat(head, side, F.lit('<main style="white-space:pre-wrap">'), marked(text, marks), F.lit("</main></body></html>\n"))
