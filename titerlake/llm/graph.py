"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of vectors.

A shard's graph starts with random edges. Batches of its vectors then search the graph greedily from the start nodes; the
nodes they expand on the way are proposed as neighbours. Relaxed distance pruning takes them nearest first and drops each
that lies ``ALPHA`` times nearer to one already taken than to the vector itself, so that the edges kept point into
different directions. Edges get their reverse, and a list that overflows is pruned by the same rule. Nodes that no path
reaches become start nodes themselves. The index is a table; a query block beam-searches every shard, and the best of
all shards are ranked by their exact distance in double precision.

Equal vectors of a shard share one node that lists all their rows, so many copies are one stop of a search and none is
lost. All searches of a batch run in step as numpy arrays.

Defined cases: null vectors, zero ones (and empty ones), those with null or non-finite components, and rows of a null
id take no part; of rows that share an id the least vector counts; a shorter vector ends in zeros; ties go to the smaller
id; a query with fewer than k others gets all of them; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titerlake.llm.scratch import Scratch
from titerlake.llm.text import pick
from titerlake.llm.vectors import dealt, finite, longest, matrix, one_per_id

#: Rows of a shard and queries of a block, about; out-edges of a node; beams of the build and of queries; nodes expanded a step.
SHARD_ROWS, BLOCK_QUERIES, DEGREE, BUILD_BEAM, BEAM, WIDTH, ALPHA = 8192, 65536, 32, 32, 160, 4, 1.2
#: Vectors searched in step, and pairs of proposed nodes compared at once.
_BATCH, _PAIRS = 512, 1 << 22


class Graph:
    """Directed graph over the rows of ``points``; ``edges`` is -1 beyond a node's neighbours, ``starts`` begin each search."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, starts: np.ndarray):
        # one further row stands for "no node", infinitely far from all
        self.points = np.concatenate([points, np.zeros((1, points.shape[1]))]).astype(np.float32)
        self.norms = np.concatenate([(self.points[:-1].astype(np.float64) ** 2).sum(1), [np.inf]]).astype(np.float32)
        self.n = len(points)
        self.edges = np.where(edges < 0, self.n, edges)
        self.starts = starts

    def distances(self, nodes: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of ``nodes``."""
        dots = np.matmul(self.points[nodes], queries[:, :, None])[:, :, 0]
        return np.maximum(self.norms[nodes] + lengths[:, None] - 2 * dots, 0)

    def search(self, queries: np.ndarray, beam: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The ``beam`` nearest nodes met by each query and their squared distances, and the nodes expanded at each step."""
        queries = queries.astype(np.float32)
        lengths = (queries**2).sum(1)
        b, n = len(queries), self.n
        seen = np.zeros((b, n + 1), bool)
        nodes = np.broadcast_to(self.starts, (b, len(self.starts)))
        seen[:, self.starts] = True
        far = self.distances(nodes, queries, lengths)
        pad = max(0, beam - nodes.shape[1])
        nodes = np.concatenate([nodes, np.full((b, pad), n)], 1)
        far = np.concatenate([far, np.full((b, pad), np.inf, np.float32)], 1)
        order = np.argsort(far, 1, kind="stable")[:, :beam]
        nodes, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)
        done = nodes == n
        path: list[np.ndarray] = []
        active = np.arange(b)
        while len(active):
            # the first ``width`` nodes of each beam not expanded yet
            now = np.argsort(done[active], 1, kind="stable")[:, :width]
            fresh = ~np.take_along_axis(done[active], now, 1)
            at = np.where(fresh, np.take_along_axis(nodes[active], now, 1), n)
            done[active[:, None], now] = True
            step = np.full((b, width), n)
            step[active] = at
            path.append(step)
            near = self.edges[np.minimum(at, n - 1)]
            near = np.where((at == n)[:, :, None], n, near).reshape(len(active), -1)
            near = np.sort(near, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near = np.where(seen[active[:, None], near], n, near)
            seen[active[:, None], near] = True
            seen[:, n] = False
            gap = self.distances(near, queries[active], lengths[active])
            all_nodes = np.concatenate([nodes[active], near], 1)
            all_far = np.concatenate([far[active], gap], 1)
            all_done = np.concatenate([done[active], near == n], 1)
            order = np.argsort(all_far, 1, kind="stable")[:, :beam]
            nodes[active], far[active] = np.take_along_axis(all_nodes, order, 1), np.take_along_axis(all_far, order, 1)
            done[active] = np.take_along_axis(all_done, order, 1)
            active = active[~done[active].all(1)]
        return nodes, far, path

    def pruned(self, owners: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        """For each owner at most ``degree`` of its proposed nodes, none ``alpha`` times nearer to another one kept than to it."""
        n = self.n
        proposed = np.sort(np.where(proposed == owners[:, None], n, proposed), 1)
        proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = n
        far = self.distances(proposed, self.points[owners], self.norms[owners])
        far[proposed == n] = np.inf
        order = np.argsort(far, 1, kind="stable")
        proposed, far = np.take_along_axis(proposed, order, 1), np.take_along_axis(far, order, 1)
        most = max(1, int((far < np.inf).sum(1).max(initial=0)))
        out = np.full((len(owners), degree), n)
        part = max(1, _PAIRS // (most * most))
        for low in range(0, len(owners), part):
            self._prune_part(proposed[low : low + part, :most], far[low : low + part, :most], alpha, out[low : low + part])
        return out

    def _prune_part(self, proposed: np.ndarray, far: np.ndarray, alpha: float, out: np.ndarray) -> None:
        vectors, lengths = self.points[proposed], self.norms[proposed]
        with np.errstate(invalid="ignore"):
            between = np.matmul(vectors, vectors.transpose(0, 2, 1)) * np.float32(-2)
            between += lengths[:, :, None]
            between += lengths[:, None, :]
        crowded = alpha * alpha * np.maximum(between, 0) <= far[:, None, :]  # [owner, kept, dropped]
        alive = far < np.inf
        rows = np.arange(len(proposed))
        for k in range(out.shape[1]):
            first = alive.argmax(1)
            left = alive[rows, first]
            if not left.any():
                break
            out[left, k] = proposed[left, first[left]]
            alive &= ~crowded[rows, first]
            alive[rows, first] = False

    def add_reverse(self, owners: np.ndarray, degree: int, alpha: float) -> None:
        """Hang each owner on the nodes it points at; a node with too many is pruned."""
        source = np.repeat(owners, degree)
        target = self.edges[owners].ravel()
        source, target = source[target < self.n], target[target < self.n]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, begin, count = np.unique(target, return_index=True, return_counts=True)
        # groups of targets with about equally many new edges keep the padded arrays small
        for low, high in ((0, 8), (8, 32), (32, 128), (128, self.n + 1)):
            group = np.flatnonzero((count > low) & (count <= high))
            for part in range(0, len(group), _BATCH):
                g = group[part : part + _BATCH]
                most = int(count[g].max())
                place = np.arange(most)[None, :]
                extra = np.where(place < count[g][:, None], source[np.minimum(begin[g][:, None] + place, len(source) - 1)], self.n)
                self.edges[heads[g]] = self.pruned(heads[g], np.concatenate([self.edges[heads[g]], extra], 1), degree, alpha)

    def reached(self) -> np.ndarray:
        seen = np.zeros(self.n + 1, bool)
        front = self.starts
        seen[front] = True
        while len(front):
            front = np.unique(self.edges[front])
            front = front[(front < self.n) & ~seen[front]]
            seen[front] = True
        return seen[:-1]


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> Graph:
    """The graph of distinct ``points``; it follows from their order alone."""
    n = len(points)
    rng = np.random.default_rng(seed)
    edges = np.full((n, degree), -1)
    if n > 1:
        some = min(degree // 2, n - 1)
        edges[:, :some] = (np.arange(n)[:, None] + rng.integers(1, n, (n, some))) % n
    middle = np.argmin(((points - points.mean(0)) ** 2).sum(1)) if n else 0
    graph = Graph(points, edges, np.array([middle] if n else [], np.int64))
    # small batches first: later ones search a graph that knows the earlier ones
    order, low = rng.permutation(n), 0
    while low < n:
        batch = order[low : low + min(_BATCH, max(32, low))]
        low += len(batch)
        _, _, path = graph.search(graph.points[batch], beam)
        proposed = np.concatenate([*path, graph.edges[batch]], 1)
        graph.edges[batch] = graph.pruned(batch, proposed, degree, alpha)
        graph.add_reverse(batch, degree, alpha)
    while n and not (reached := graph.reached()).all():
        graph.starts = np.append(graph.starts, np.flatnonzero(~reached)[0])
    return graph


def _scale(*parts: np.ndarray) -> float:
    """A factor that brings the longest vector to length 1, so that single precision holds all squares."""
    longest = max((float(np.abs(p).max(initial=0)) for p in parts), default=0) * math.sqrt(parts[0].shape[1])
    return 1 / longest if longest > 0 else 1.0


def _shard_builder(kind: pa.DataType, degree: int, beam: int, alpha: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, points = np.asarray(table["vec_id"], np.int64), matrix(table["embedding"])
        keep = one_per_id(ids, points)
        ids, points = ids[keep], points[keep]
        # equal vectors are one node; nodes are numbered by their smallest id
        _, first, group = np.unique(points, axis=0, return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))
        node, heads = rank[group.ravel()], np.sort(first)
        graph = build_graph(points[heads] * _scale(points), degree, beam, alpha)
        known = graph.edges < graph.n
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(known.sum(1))]), pa.int32()), pa.array(graph.edges[known], pa.int32()))
        lead = np.zeros(len(ids), bool)
        lead[heads] = True
        at = np.where(lead, node, 0)
        starts = np.zeros(len(heads), bool)
        starts[graph.starts] = True
        neighbours = lists.take(pa.array(at, mask=~lead))
        vectors = table["embedding"].combine_chunks().take(pa.array(keep)).cast(pa.list_(kind))
        shard = pa.array(np.full(len(ids), key[0].as_py()), pa.int32())
        return pa.table([shard, pa.array(node, pa.int32()), pa.array(ids), vectors, neighbours, pa.array(lead & starts[node])], names=["shard", "node", "vec_id", "embedding", "neighbours", "start"])

    return run


def index_vectors(
    vectors: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """A row for every vector: its shard, its node there, and, on one row of each node, the node's neighbours and whether searches start there.

    The table is meant to be written; a shard is built by one task from about ``shard_rows`` rows.
    """
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    rows = vectors.select(*pick((id_col, "vec_id"), (vector_col, "embedding")))
    single = rows.schema["embedding"].dataType.elementType.simpleString() == "float"
    element = "float" if single else "double"
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{element}>"), dealt("vec_id", shards, 11).alias("shard"))
    shape = f"shard int, node int, vec_id long, embedding array<{element}>, neighbours array<int>, start boolean"
    return rows.groupBy("shard").applyInArrow(_shard_builder(pa.float32() if single else pa.float64(), degree, beam, alpha), shape)


def _shard_search(k: int, beam: int):
    names = ["query_id", "vec_id", "score"]

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if index.num_rows and queries.num_rows:
            width = longest(index["embedding"], queries["embedding"])
            node, ids, points = np.asarray(index["node"], np.int64), np.asarray(index["vec_id"], np.int64), matrix(index["embedding"], width)
            queries_ids, wanted = np.asarray(queries["query_id"], np.int64), matrix(queries["embedding"], width)
            order = np.lexsort([ids, node])
            node, ids, points = node[order], ids[order], points[order]
            begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            count = np.diff(np.concatenate([begin, [len(node)]]))
            lists = index["neighbours"].combine_chunks().take(pa.array(order))
            lead = np.flatnonzero(np.asarray(lists.is_valid()))  # one row for each node, in the order of nodes
            lists = lists.take(pa.array(lead))
            degrees = np.diff(np.asarray(lists.offsets))
            edges = np.full((len(lead), max(1, int(degrees.max(initial=0)))), -1)
            edges[np.arange(edges.shape[1])[None, :] < degrees[:, None]] = np.asarray(lists.flatten())
            starts = np.flatnonzero(np.asarray(index["start"].combine_chunks().take(pa.array(order)))[lead])
            scale, heads = _scale(points, wanted), points[begin]
            graph = Graph(heads * scale, edges, starts)
            for low in range(0, len(wanted), _BATCH // 2):
                part, part_ids = wanted[low : low + _BATCH // 2], queries_ids[low : low + _BATCH // 2]
                nodes, _, _ = graph.search(part * scale, max(beam, k + 1))
                hit = nodes < graph.n
                exact = np.sqrt(((heads[np.where(hit, nodes, 0)] - part[:, None, :]) ** 2).sum(2))
                q, n, d = np.repeat(np.arange(len(part)), hit.sum(1)), nodes[hit], exact[hit]
                times = np.minimum(count[n], k + 1)  # a node's rows are ascending; no more can be among the k nearest
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                q, d, v = np.repeat(q, times), np.repeat(d, times), ids[np.repeat(begin[n], times) + place]
                other = v != part_ids[q]
                q, d, v = q[other], d[other], v[other]
                best = np.lexsort([v, d, q])
                q, d, v = q[best], d[best], v[best]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                for column, values in zip(found, (part_ids[q], v, d), strict=True):
                    column.append(values[rank < k])
        return pa.table([pa.array(np.concatenate(c)) for c in found], names=names)

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` rows of ``index`` found nearest to each of ``queries(query_id, embedding)``, but for the one of the query's own id.

    Every shard meets every block of queries in one task; a task holds a shard and a block, no more.
    """
    spark = index.sparkSession
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, math.ceil(queries.count() / block_queries))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select("query_id", "embedding", dealt("query_id", blocks, 13).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards * blocks, 100_000))
    keys = ["shard", "block"]
    found = left.repartition(spread, *keys).groupBy(*keys).cogroup(right.repartition(spread, *keys).groupBy(*keys)).applyInArrow(_shard_search(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op11_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = Scratch(spark, "graph").save(index_vectors(vectors), "index")
    return nearest(index, index.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding"))
