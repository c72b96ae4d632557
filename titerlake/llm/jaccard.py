"""Exact n-gram Jaccard join by multiple-global-order prefix filtering.

A document's set is its distinct ``k``-word shingles (as 64-bit hashes). Two sets with Jaccard similarity t or more
share a token among the first ``n - ceil(t * n) + 1`` of each, whatever total order all sets are sorted by. ``ORDERS``
such orders are used. Each sorts by a frequency level first, rare tokens first, and inside a level by a hash of its
own. The level says how far above the mean a token's counter lies, in a table of ``WIDTH`` counters that count all
shingles of all texts by hash; a coarse table makes the orders worse, never wrong.

Steps, each a Spark job over all documents:
1. per text: set size, 128-bit fingerprint of the set, and the frequency table, summed over all texts;
2. equal sets become one class, represented by its smallest doc_id;
3. prefix tokens of the representatives under the first order, somewhat more than needed for one common token: so long
   documents must share several. Documents that may be linked by these are tied, and the components of the ties are
   *clusters*: no two documents of different clusters can be linked;
4. the sets of clustered documents, and of no others, go to tasks of one cluster each, or, of a large cluster, of one
   block of a size class and the class's pivots. A task takes the pairs that share prefix tokens under every order, the
   filters intersected, verifies them by exact overlap and returns a star for each group of linked documents, so large
   groups don't emit all their pairs;
5. in large clusters, documents that are not in the cluster's largest component yet (the rest) are compared in the
   same way with all blocks of their own and the neighbouring size classes. Two documents in one component need no
   comparison, so what is left grows with the rest times the cluster, not with the cluster's square;
6. components of all links, and of the classes, give ``component_id``.

Linked sets differ in size by a factor of at most ``100 / percent``; size classes are powers of that factor, so linked
sets are in the same class or in neighbours.

Defined cases: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; with fewer than ``k`` words the whole sequence is
the one shingle; null text, or one without words, has an empty set, links with nothing and is its own component;
rows that share a doc_id are compared each with its own set and share a component where that id represents both; a
null doc_id has no component (null); an empty table gives no rows; further columns are ignored.

The result reads the tables ``profile``, ``classes`` and the last one of the components; all others are dropped when
the last step that reads them is done.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerlake.llm.components import connected_components
from titerlake.llm.scratch import Scratch
from titerlake.llm.text import mixed, pick, slices, word_hashes

ORDERS = 3
#: Counters of the frequency table; fixed, so what the driver gets and broadcasts has a fixed size.
BITS = 21
WIDTH = 1 << BITS
PIECE = 1 << 16
#: Tokens that a task holds before it counts them, and bytes of text that it hashes at once (one longer text is hashed by itself).
HELD, HASHED = 1 << 19, 1 << 19
#: The ties' prefixes have a token more for every so many of the set, and linked sets share as many more.
MORE = 32
#: Holders of a prefix token up to which its pairs are formed; beyond, they are tied to the least one of a size class.
HEAVY = 64
#: Documents of a cluster that is one task, of one block of a larger one, and pivots that all blocks of a class get.
BLOCK, PIVOTS = 256, 32
#: Bits of the filter that keeps unclustered documents out of the shuffle of sets: a fixed size, false hits do no harm.
FILTER_BITS, FILTER_HASHES = 1 << 25, 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each; and where each text's begin."""
    flat, starts = word_hashes(texts, lower=True)
    lengths = np.diff(starts)
    n = max(len(flat) - k + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = (rolled ^ (rolled >> np.uint64(31))) * _GOLD + flat[j : j + n]
    rolled = mixed(rolled)
    counts = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], np.uint64)
    for begin, words, low, high in zip(starts.tolist(), lengths.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        if words >= k:
            out[low:high] = rolled[begin : begin + high - low]
            out[low:high].sort()
        elif words:
            out[low] = xxhash.xxh3_64_intdigest(flat[begin : begin + words].tobytes(), seed=k)
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[offsets[:-1][counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[offsets]


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BITS)).astype(np.int64)


def frequency_levels(counts: np.ndarray) -> np.ndarray:
    """0 for counters about or below the mean, then by powers of two of their excess in standard deviations."""
    excess = (counts - counts.mean()) / max(np.sqrt(counts.mean()), 1.0)
    return np.ceil(np.log2(np.maximum(excess, 1.0)) * 2).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def prefixes_of(tokens: np.ndarray, offsets: np.ndarray, order: int, levels: np.ndarray, percent: int, least: int = 0) -> list[np.ndarray]:
    """The first tokens of each set under an order: frequency level, then a hash of its own. Not sorted.

    With ``least``, a set of n gets ``n // least`` tokens more, so linked sets share that many tokens more.
    """
    spread = (tokens ^ (tokens >> np.uint64(29))) * np.uint64(_SPREAD[order])
    key = (levels[_bucket(tokens)].astype(np.uint64) << np.uint64(56)) | (spread >> np.uint64(8))
    out = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = min(prefix_length(high - low, percent) + ((high - low) // least if least else 0), high - low)
        at = np.argpartition(key[low:high], n - 1)[:n] if n else slice(0)
        out.append(tokens[low:high][at])
    return out


def _profile(k: int):
    """Rows of kind 0: a document's set size and fingerprint. Rows of kind 1: a piece (``f1``) of the task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(WIDTH, np.int64), []
        for whole in batches:
            for batch in slices(whole, limit=HASHED):
                high, low = [], []
                flat, offsets = shingle_sets(batch.column("text"), k)
                sizes = np.diff(offsets)
                raw = flat.tobytes()
                for start, end in zip(8 * offsets[:-1], 8 * offsets[1:], strict=True):
                    digest = xxhash.xxh3_128_intdigest(raw[start:end])
                    high.append((digest >> 64) - (1 << 63))
                    low.append((digest & (1 << 64) - 1) - (1 << 63))
                held.append(_bucket(flat))
                if sum(map(len, held)) > HELD:
                    counts += np.bincount(np.concatenate(held), minlength=WIDTH)
                    held = []
                yield _rows(batch.column("doc_id"), sizes, high, low, [None] * len(sizes))
        if held:
            counts += np.bincount(np.concatenate(held), minlength=WIDTH)
        pieces = range(WIDTH // PIECE)
        data = [zlib.compress(counts[p * PIECE : (p + 1) * PIECE].astype(np.uint32).tobytes(), 1) for p in pieces]
        yield _rows(pa.nulls(len(data), pa.int64()), [0] * len(data), list(pieces), [0] * len(data), data)

    return run


def _rows(ids, n, high, low, piece) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pc.cast(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(piece, pa.binary())],
        names=["doc_id", "n", "f1", "f2", "piece"],
    )


def _sum_pieces(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(PIECE, np.int64)
    for batch in batches:
        for raw in batch.column("piece").to_pylist():
            total += np.frombuffer(zlib.decompress(raw), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["f1", "piece"])


def _prefix_rows(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for whole in batches:
            for batch in slices(whole, limit=HASHED):
                flat, offsets = shingle_sets(batch.column("text"), k)
                tokens = pa.array([x.view(np.int64) for x in prefixes_of(flat, offsets, 0, levels, percent, MORE)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(np.diff(offsets), pa.int32()), tokens], names=["doc_id", "n", "tokens"])

    return run


def _size_class(n: str, percent: int):
    return F.floor(F.log(F.col(n).cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col(n).cast("int")


def _ties(prefixes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges ``a, b`` between documents that may be linked; the ends of every link are joined by a path of them.

    Prefixes are ``n // MORE`` tokens longer than needed for one common token, so linked sets of x and y tokens share
    ``1 + min(x, y) // MORE``. A document is *dense* if at least ``1 + n // MORE`` of its prefix tokens have more than
    ``HEAVY`` holders. Linked documents that aren't both dense must share other tokens, which have few holders: those
    give pairs, of which the ones with too few common tokens or sizes too far apart go. Two dense documents may share
    heavy tokens alone: each of these ties its dense holders to the least one of their size class, and those of
    neighbouring classes to each other.
    """
    postings = prefixes.select("doc_id", "n", F.explode("tokens").alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("holders")).where(F.col("holders") > 1)
    held = scratch.save(postings.join(shared, "token"), "held")

    weight = held.where(F.col("holders") > HEAVY).groupBy("doc_id").agg(F.count("*").alias("heavy"), F.min("n").alias("least"))
    weight = scratch.save(weight, "weight")
    dense = weight.where(F.col("heavy") > F.floor(F.col("least") / MORE)).select("doc_id")
    heavy = held.where(F.col("holders") > HEAVY).join(dense, "doc_id").select("token", "doc_id", _size_class("n", percent).alias("cls"))
    heavy = scratch.save(heavy, "heavy")
    heads = scratch.save(heavy.groupBy("token", "cls").agg(F.min("doc_id").alias("head")), "heads")
    inside = heavy.join(heads, ["token", "cls"]).select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    above = heads.select("token", (F.col("cls") - 1).alias("cls"), F.col("head").alias("a"))
    across = above.join(heads, ["token", "cls"]).select("a", F.col("head").alias("b"))

    light = held.where(F.col("holders") <= HEAVY).select("token", "doc_id", "n")
    x, y = (light.select("token", F.col("doc_id").alias(s), F.col("n").alias("n" + s)) for s in "ab")
    fits = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = x.join(y, "token").where(fits).groupBy("a", "b").agg(F.count("*").alias("common"), F.min(F.least("na", "nb")).alias("n"))
    for side in "ab":
        pairs = pairs.join(weight.select(F.col("doc_id").alias(side), F.col("heavy").alias("h" + side)), side, "left")
    least = 1 + F.floor(F.col("n") / MORE) - F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    pairs = pairs.where(F.col("common") >= least).select("a", "b")

    ties = scratch.save(pairs.unionByName(inside).unionByName(across).where(F.col("a") != F.col("b")).distinct(), "ties")
    for frame in (held, weight, heavy, heads):
        scratch.drop(frame)
    return ties


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _inverted(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in order, and the set each comes from."""
    tokens = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owner[order]


def _owners(index: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """Owners of all postings of the tokens, once for each token."""
    low = np.searchsorted(index[0], tokens, "left")
    count = np.searchsorted(index[0], tokens, "right") - low
    starts = np.cumsum(count) - count
    return index[1][np.arange(count.sum()) + np.repeat(low - starts, count)]


def link_sets(flat: np.ndarray, offsets: np.ndarray, comps: np.ndarray, left: np.ndarray | None, levels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components, as a spanning forest: of all sets, or of ``left`` with the others.

    Sets whose component (``comps``) is already the same are not compared.
    """
    prefixes = [prefixes_of(flat, offsets, o, levels, percent) for o in range(ORDERS)]
    sets = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    indexes = [_inverted(p) for p in prefixes]
    whole = _inverted(sets)
    sizes = np.diff(offsets)
    forest, out = _Forest(len(sets)), []
    first: dict[int, int] = {}
    for i, comp in enumerate(comps.tolist()):
        forest.join(i, first.setdefault(comp, i))
    for x in range(len(sets)) if left is None else np.flatnonzero(left):
        mask = ~left if left is not None else np.arange(len(sets)) > x
        for order in range(ORDERS):  # the filters of all orders, intersected
            shared = np.zeros(len(sets), bool)
            shared[_owners(indexes[order], prefixes[order][x])] = True
            mask &= shared
            if not mask.any():
                break
        near = np.flatnonzero(mask)
        near = near[(100 * sizes[near] >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes[near])]
        near = np.array([y for y in near if forest.find(y) != forest.find(x)], np.int64)
        if not len(near):
            continue
        if len(near) > 4:
            common = np.bincount(_owners(whole, sets[x]), minlength=len(sets))[near]
        else:
            common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in near])
        for y in near[100 * common >= percent * (sizes[near] + sizes[x] - common)]:
            if forest.join(int(x), int(y)):
                out.append((int(x), int(y)))
    return out


def _link_tasks(percent: int, shared, cross: bool):
    """For a group of ``doc_id, comp, side, packed`` rows: its links; with ``cross``, of side 1 with side 0 alone."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_pylist()
        packed = table.column("packed").to_pylist()
        offsets = np.concatenate([[0], np.cumsum([len(x) // 8 for x in packed])]).astype(np.int64)
        flat = np.frombuffer(b"".join(packed), np.uint64)
        comps = np.asarray(table.column("comp"), np.int64)
        left = np.asarray(table.column("side"), np.int64) == 1 if cross else None
        links = link_sets(flat, offsets, comps, left, shared.value, percent) if left is None or left.any() else []
        forest, least = _Forest(len(ids)), {}
        for a, b in links:
            forest.join(a, b)
        touched = sorted({x for link in links for x in link}, key=lambda x: ids[x])
        stars = [(ids[x], least.setdefault(forest.find(x), ids[x])) for x in touched]  # each to the least of its group
        stars = [(a, b) for a, b in stars if a != b]
        return pa.table({"a": pa.array([a for a, _ in stars], pa.int64()), "b": pa.array([b for _, b in stars], pa.int64())})

    return run


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ``doc_id``; the driver gets its words, at most ``FILTER_BITS / 64`` whatever the input."""
    spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)])).alias("spot"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("spot") % 64).cast("int"))
    words = spots.groupBy(F.floor(F.col("spot") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[np.asarray(words.column("word"), np.int64)] = np.asarray(words.column("bits"), np.int64)
    return out


def _packed_sets(k: int, filter_):
    """Sets of the documents that pass the filter, as bytes. ``spots`` holds a document's bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filter_.value
        for whole in batches:
            spots = whole.column("spots").flatten().to_numpy().reshape(-1, FILTER_HASHES)
            pass_ = ((words[spots >> 6] >> (spots & 63)) & 1).all(axis=1)
            for batch in slices(whole.filter(pa.array(pass_)).drop_columns(["spots"]), limit=HASHED):
                flat, offsets = shingle_sets(batch.column("text"), k)
                raw = flat.tobytes()
                packed = [raw[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(np.diff(offsets), pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "n", "packed"])

    return run


def _verified(sets: DataFrame, percent: int, shared, scratch: Scratch) -> DataFrame:
    """``node, root`` of the components of linked documents of ``root, doc_id, n, packed``."""
    here = sets.select("root", "doc_id", "n", "packed", _size_class("n", percent).alias("cls"))
    many = sets.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
    classes = here.select("root", "cls").join(many, "root").groupBy("root", "cls").agg(F.count("*").alias("size"))
    classes = scratch.save(classes.select("root", "cls", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "size-classes")
    links = _link_tasks(percent, shared, cross=False)
    keys = ["root", "cls", "block"]
    task = [*keys, "doc_id", F.col("doc_id").alias("comp"), F.lit(0).alias("side"), "packed"]
    if classes.isEmpty():  # no large cluster: each is one task
        only = here.withColumns({"block": F.lit(0), "cls": F.lit(0)}).select(*task).groupBy(*keys).applyInArrow(links, "a long, b long")
        return connected_components(only, scratch)
    dealt = here.join(classes, ["root", "cls"], "left")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    pivot = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.floor(F.col("size") / PIVOTS), F.lit(1))) == 0
    others = F.when(pivot & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    large = F.col("blocks").isNotNull()
    dealt = dealt.withColumns({"block": F.when(large, block).otherwise(0), "cls": F.when(large, F.col("cls")).otherwise(-1)})
    first = scratch.save(dealt.withColumn("block", F.explode(others)).select(*task).groupBy(*keys).applyInArrow(links, "a long, b long"), "links")

    known = connected_components(first, scratch)
    scratch.drop(first)
    placed = dealt.where(large).join(known.withColumnRenamed("node", "doc_id").withColumnRenamed("root", "comp"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    placed = scratch.save(placed.select(*keys, "doc_id", "comp", "packed"), "placed")
    counts = placed.groupBy("root", "comp").agg(F.count("*").alias("size"))
    largest = counts.groupBy("root").agg(F.max_by("comp", F.struct("size", -F.col("comp"))).alias("largest"))
    rest = placed.join(largest, "root").where(F.col("comp") != F.col("largest")).drop("largest")
    chunks = rest.groupBy("root", "cls").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    rest = rest.join(chunks, ["root", "cls"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("chunks")).cast("int"))
    near = F.explode(F.array(*[F.col("cls") + d for d in (-1, 0, 1)]))
    blocks = classes.select("root", "cls", "blocks")
    # each chunk of the rest meets each block of its class and of the two beside it
    right = rest.select("root", F.col("cls").alias("own"), "chunk", near.alias("cls"), "doc_id", "comp", "packed").join(blocks, ["root", "cls"])
    right = right.select("root", "own", "chunk", "cls", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc_id", "comp", F.lit(1).alias("side"), "packed")
    wanted = chunks.select("root", F.col("cls").alias("own"), near.alias("cls"), "chunks")
    left = placed.join(wanted, ["root", "cls"]).select("root", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "cls", "block", "doc_id", "comp", F.lit(0).alias("side"), "packed")
    second = left.unionByName(right).groupBy("root", "own", "chunk", "cls", "block").applyInArrow(_link_tasks(percent, shared, cross=True), "a long, b long")
    second = scratch.save(second, "rest-links")
    scratch.drop(placed)
    scratch.drop(classes)
    if second.isEmpty():
        return known
    return connected_components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second), scratch)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; links need ``100 * intersection >= percent * union``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(*pick((id_col, "doc_id"), (text_col, "text"))).withColumn("doc_id", F.col("doc_id").cast("long"))

    shape = "doc_id long, n long, f1 long, f2 long, piece binary"
    profile = scratch.save(rows.mapInArrow(_profile(k), shape), "profile")
    sets = profile.where(F.col("piece").isNull()).drop("piece")
    pieces = profile.where(F.col("piece").isNotNull()).groupBy("f1").applyInArrow(_sum_pieces, "f1 long, piece binary")
    counts = np.zeros(WIDTH, np.int64)
    for row in pieces.collect():  # WIDTH counters, whatever the input
        counts[row["f1"] * PIECE : (row["f1"] + 1) * PIECE] = np.frombuffer(row["piece"], np.int64)
    shared = spark.sparkContext.broadcast(frequency_levels(counts))

    usable = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.save(usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()

    prefixes = rows.mapInArrow(_prefix_rows(k, percent, shared), "doc_id long, n int, tokens array<long>")
    prefixes = scratch.save(prefixes.join(reps, "doc_id", "left_semi"), "prefixes")
    ties = _ties(prefixes, percent, scratch)
    scratch.drop(prefixes)
    roots = connected_components(ties, scratch)
    scratch.drop(ties)
    clusters = scratch.save(roots.select(F.col("node").alias("doc_id"), "root").unionByName(roots.select(F.col("root").alias("doc_id"), "root").distinct()), "clusters")

    filter_ = spark.sparkContext.broadcast(_id_filter(clusters))
    spots = F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)]).alias("spots")
    packed = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "text", spots).mapInArrow(_packed_sets(k, filter_), "doc_id long, n int, packed binary")
    members = scratch.save(packed.where(F.col("n") > 0).join(clusters, "doc_id"), "members")
    scratch.drop(clusters)
    joined = _verified(members, percent, shared, scratch)
    scratch.drop(members)

    named = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("root", "rep").alias("component_id"))
    known = sets.where(F.col("n") > 0).join(named, ["f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    empty = sets.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return known.unionByName(empty)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, k=4, percent=85)
