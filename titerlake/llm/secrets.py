"""Secret scan through a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression: an AND of clauses, each an OR over
alternative literals, each an AND of the literal's trigrams. Documents are indexed in blocks (slices of Arrow
batches): a block's index maps each trigram that some rule asks for to the sorted list of its documents. Postings
are intersected and united as the query says, and the rule's expression runs over the candidates only. A rule
without a mandatory trigram is run over every text. The index covers all bytes of every text.

Defined cases: null text counts as empty; spans are in code points of the text as it is, end exclusive; repeated
rows give repeated results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from titerlake.llm.text import buffers, filled, pick, slices

#: Alternatives that a literal may branch into before the derivation gives up on it.
MOST_LITERALS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost, non-overlapping matches; those where ``group`` has under ``least`` code points go."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Base kinds first, then what this scanner adds (fixed values).
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]]:
    """AND of ORs of ANDs of lower-case trigrams that every match must hold; empty: any text may match."""
    clauses: list[list[frozenset[bytes]]] = []

    def close(literals: set[str]) -> None:
        """Turn a finished run of literals into a clause, if each alternative has a trigram."""
        options = []
        for literal in literals:
            raw = literal.lower().encode()
            options.append(frozenset(raw[i : i + 3] for i in range(len(raw) - 2)))
        if options and all(options):
            clauses.append(options)

    def exact(items) -> set[str] | None:
        """All strings the items can match, or None if they are too many to list."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                more = {chr(arg)} if arg < 128 else None
            elif op is sre.IN:
                more = set()
                for kind, value in arg:
                    if kind is sre.LITERAL and value < 128:
                        more.add(chr(value).lower())
                    elif kind is sre.RANGE and value[1] < 128 and value[1] - value[0] < 8:
                        more |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                    else:
                        more = None
                        break
            elif op is sre.SUBPATTERN:
                more = exact(arg[-1])
            elif op is sre.BRANCH:
                parts = [exact(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is sre.MAX_REPEAT and arg[1] <= 3:
                one = exact(arg[2])
                more = None if one is None else {"".join(x) for k in range(arg[0], arg[1] + 1) for x in _powers(one, k)}
            else:
                more = None
            if more is None or len(out) * len(more) > MOST_LITERALS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items) -> None:
        run = {""}
        for item in items:
            more = exact([item])
            if more is not None and len(more) * len(run) <= MOST_LITERALS:
                run = {a + b for a in run for b in more}
                continue
            close(run)
            run = {""}
            op, arg = item
            if op is sre.SUBPATTERN:
                walk(arg[-1])
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        close(run)

    walk(list(sre_parser.parse(pattern)))
    return clauses


def _powers(options: set[str], times: int) -> set[tuple[str, ...]]:
    out: set[tuple[str, ...]] = {()}
    for _ in range(times):
        out = {(*a, b) for a in out for b in options}
    return out


class TrigramIndex:
    """Postings of one block of texts for a vocabulary of trigrams, over ASCII-lower-cased UTF-8 bytes."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.number = np.zeros(1 << 24, np.uint16)
        for gram, k in vocabulary.items():
            self.number[gram[0] << 16 | gram[1] << 8 | gram[2]] = k + 1
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each trigram of the vocabulary, the ascending positions of the texts that hold it."""
        if len(data) < 3:
            return [np.zeros(0, np.int64)] * len(self.vocabulary)
        low = self.fold[data]
        found = self.number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(found)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * len(offsets) + text[inside])
        cuts = np.searchsorted(pairs, np.arange(1, len(self.vocabulary) + 2) * len(offsets))
        return [pairs[a:b] % len(offsets) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def candidates(self, query: list[list[frozenset[bytes]]], postings: list[np.ndarray], n: int) -> np.ndarray:
        """Texts that satisfy the query; all of them if it asks for nothing."""
        out = np.arange(n)
        for clause in query:
            union = np.zeros(0, np.int64)
            for grams in clause:
                lists = sorted((postings[self.vocabulary[g]] for g in grams), key=len)
                hit = lists[0]
                for other in lists[1:]:
                    hit = np.intersect1d(hit, other, assume_unique=True)
                union = np.union1d(union, hit)
            out = np.intersect1d(out, union, assume_unique=True)
        return out


def _spans(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_batches(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...] = RULES) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` in; ``doc_id, spans`` out, spans as list of (kind, start, end) by start, then rule."""
    compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for clause in q for option in clause for g in option})
    index = TrigramIndex({g: k for k, g in enumerate(grams)})
    for whole in batches:
        for batch in slices(whole):
            texts = filled(batch.column("text"))
            postings = index.postings(*buffers(texts))
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            strings = texts.to_pylist()
            for k, rule in enumerate(rules):
                for i in index.candidates(queries[k], postings, batch.num_rows):
                    found[i] += [(start, k, end) for start, end in _spans(rule, compiled[k], strings[i])]
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, spans array<struct<kind, start, end>>``."""
    rows = docs.select(*pick((id_col, "doc_id"), (text_col, "text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: scan_batches(batches, rules), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = {r.kind for r in BASE_RULES}
    for batch in scan_batches(batches):
        rows = batch.column("spans").to_pylist()
        joined = [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans) for spans in rows]
        own = [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in base) for spans in rows]
        counts = [pa.array([sum(s["kind"] == r.kind for s in spans) for spans in rows], pa.int64()) for r in BASE_RULES]
        yield pa.RecordBatch.from_arrays(
            [pc.cast(batch.column("doc_id"), pa.int64()), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own]), pa.array(joined, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
