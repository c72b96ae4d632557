"""The operators on vectors and the filter audit, against plain loops."""

import math
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from titerlake.llm import audit, graph, negatives
from titerlake.llm.catalog import QUERIES
from titerlake.llm.scratch import Scratch
from titerlake.llm.vectors import matrix, one_per_id

VECTORS = "vec_id long, embedding array<float>, label int, shard int, node int, block int, rank int, positives string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, k, None, None, None, None, None) for i, v, k in rows], VECTORS)


def odd_rows(n=260, dim=8):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=dim)], int(i % 3)) for i in range(n)]
    rows += [(n + i, rows[5][1], i % 3) for i in range(90)]  # many copies of one vector
    rows += [(1000, None, 1), (1100, [0.0] * dim, 1), (1200, [1.0, None] + [0.0] * (dim - 2), 1), (1300, [math.nan] * dim, 1), (1400, [math.inf] * dim, 1)]
    rows += [(None, [1.0] * dim, 1), (1500, [], 1), (1600, [0.5, 0.5], 1), (7, rows[7][1], rows[7][2]), (100, [9.0] * dim, 2), (1700, [2.0] * dim, None)]
    return rows


def usable(rows, zero):
    """One row an id, as the operators define it."""
    found = {}
    for i, v, k in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if zero and (k is None):
            continue
        if not zero and not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        v += [0.0] * (8 - len(v))
        found[i] = min(found.get(i, (k if zero else 0, v)), (k if zero else 0, v))
    return found


def run_graph(spark, frame, shard_rows, k=10, block_queries=3):
    index = Scratch(spark, "case").save(graph.index_vectors(frame, shard_rows=shard_rows), "index")
    queries = index.where("vec_id % 100 = 0").selectExpr("vec_id query_id", "embedding")
    return index, graph.nearest(index, queries, k=k, block_queries=block_queries)


@pytest.mark.parametrize("shard_rows", [64, 10000])
def test_graph_equals_brute_force_on_odd_rows(spark, shard_rows):
    rows = odd_rows()
    index, found = run_graph(spark, vector_frame(spark, rows), shard_rows)
    good = usable(rows, zero=False)
    assert sorted(r["vec_id"] for r in index.collect()) == sorted(good)
    want = []
    for q in (i for i in good if i % 100 == 0):
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(good[q][1], v, strict=True))), i) for i, (_, v) in good.items() if i != q)[:10]
        want += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found.collect()) == sorted(want)


def test_graph_few_rows_and_none(spark):
    _, found = run_graph(spark, vector_frame(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (200, [3.0, 2.0], 1)]), 100)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == [(0, 1, 1, 0.0), (0, 2, 200, 2.0), (200, 1, 0, 2.0), (200, 2, 1, 2.0)]
    _, none = run_graph(spark, vector_frame(spark, []), 100)
    assert none.count() == 0


def test_graph_recall_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    table = pq.read_table(f"{sf}/embeddings.parquet")
    ids, points = table["vec_id"].to_numpy(), matrix(table["embedding"])
    got = {}
    for r in QUERIES["op11_graph_neighbours"](spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((points - points[ids == q][0]) ** 2).sum(1))
        true = [i for _, i in sorted((d, i) for d, i in zip(far, ids, strict=True) if i != q)[:10]]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(d - far[ids == i][0]) < 1e-12 for _, i, d in mine)
        hits += len(set(true) & {i for _, i, _ in mine})
    assert hits / 10 / len(got) >= 0.95


def test_graph_reaches_every_node_and_keeps_diverse_edges():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(300, 4)), rng.normal(size=(300, 4)) + 50])  # two far groups
    made = graph.build_graph(points, degree=8, beam=16)
    assert made.reached().all() and ((made.edges < made.n).sum(1) <= 8).all()
    nodes, _, _ = made.search(points[:50], 32)
    brute = ((points[:50, None] - points[None]) ** 2).sum(2).argsort(1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(nodes, brute, strict=True)]) > 0.95
    edge = made.pruned(np.array([0]), np.arange(600)[None], 8, 1.2)[0]
    kept = [points[e] for e in edge if e < 600]
    for a in range(len(kept)):
        for b in range(a):
            assert 1.44 * ((kept[a] - kept[b]) ** 2).sum() > ((kept[a] - points[0]) ** 2).sum() * 0.999


@pytest.mark.parametrize("sizes", [(64, 2), (10000, 100)])
def test_hard_negatives_equal_brute_force_on_odd_rows(spark, sizes):
    rows = odd_rows()
    frame = vector_frame(spark, rows)
    got = negatives.mine_hard_negatives(frame, frame.where("vec_id % 10 = 0"), shard_rows=sizes[0], block_anchors=sizes[1])
    good = {i: (k, [math.floor(256 * x) for x in v]) for i, (k, v) in usable(rows, zero=True).items()}
    want = []
    for a in (i for i in good if i % 10 == 0):
        score = {i: sum(x * y for x, y in zip(good[a][1], v, strict=True)) for i, (_, v) in good.items() if i != a}
        best = sorted((-s, i) for i, s in score.items() if good[i][0] == good[a][0])[:5]
        for minus, p in best:
            inside = sorted((-s, i) for i, s in score.items() if good[i][0] != good[a][0] and 30 * -minus <= 100 * s <= 90 * -minus)[:10]
            want += [(a, p, r + 1, i, -minus, -s) for r, (s, i) in enumerate(inside)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert negatives.mine_hard_negatives(vector_frame(spark, []), vector_frame(spark, [])).count() == 0


def test_buckets_are_skipped_by_norm_and_large_numbers_stay_exact():
    rng = np.random.default_rng(2)
    vectors = negatives.whole_numbers(rng.normal(size=(6000, 16)) * rng.lognormal(0, 1, 6000)[:, None])
    buckets = negatives.Buckets(np.arange(6000), np.zeros(6000, int), vectors)
    anchors = vectors[:40]
    best = buckets.search(anchors, np.arange(40), np.full(40, -np.inf), 5, lambda q, s, i, k: np.ones(s.shape, bool))
    exact = (anchors @ vectors.T).astype(np.int64)
    assert buckets.met < 40 * 6000 / 2
    for a in range(40):
        order = np.lexsort([np.arange(6000), -exact[a]])[:5]
        assert list(best.id[best.query == a]) == list(order)
    big = np.array([[2.0**40, 3.0], [2.0**40, 5.0]])
    assert negatives.Buckets(np.arange(2), np.zeros(2, int), big).scores(big[:1], 0).tolist() == [[2**63 - 1, 2**63 - 1]]
    mean = np.array([[2.0**28, 3.0], [2.0**28, 5.0]])
    assert negatives.Buckets(np.arange(2), np.zeros(2, int), mean).scores(np.array([[1.0, 2.0**27]]), 0).tolist() == [[2**28 + 5 * 2**27, 2**28 + 3 * 2**27]]  # longest first


def test_one_row_for_each_id_and_padded_vectors():
    array = pa.array([[1.0, 2.0], None, [3.0], []], pa.list_(pa.float32()))
    assert matrix(array).tolist() == [[1, 2], [0, 0], [3, 0], [0, 0]]
    assert matrix(array.slice(2)).tolist() == [[3], [0]]
    assert one_per_id(np.array([4, 2, 4]), np.array([1, 0, 0])).tolist() == [1, 2]


DOCS = "doc_id long, text string, source string, part string, bits int, digest string, good boolean, cell int, kept int"


def audit_brute(rows, labels):
    plain = [(i, t or "", s or "") for i, t, s in rows]
    fails = []
    for i, t, _ in plain:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in plain)
        fails.append((len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, removed_by = [], {}
    for part in {s for _, _, s in plain}:
        mine = [(i, f) for (i, _, s), f in zip(plain, fails, strict=True) if s == part]
        for order in permutations(range(5)):
            left = list(mine)
            for step, f in enumerate(order):
                lost = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                name = "".join("ABCDE"[k] for k in order)
                removed_by[part, f] = removed_by.get((part, f), 0) + len(lost)
                redundant = sum(x[1][f] for x in mine) - len(lost)
                alone = sum(x[1][f] and sum(x[1]) == 1 for x in mine)
                out.append([part, name, step + 1, len(left), len(lost), redundant, alone, sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost), f])
    return sorted((*row[:-1], removed_by[row[0], row[-1]]) for row in out)


def test_audit_equals_plain_filters_on_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "a"), (2, long, "a"), (2, long, None), (2, "x", "a"), (3, None, None), (4, "", "b"), (None, long, "b"), (5, long + " $", ""), (6, "A" + long.upper(), "b")]
    rows += [(7, "word " * 60, "a"), (8, "é" * 10 + " A", "b"), (9, "w " * 200000, "b"), (10, "\x85x\x1c", "c"), (11, long, "c"), (12, long, "c")]
    labels = [(2, 1, 0), (2, 0, 1), (7, 1, None), (9, None, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*r, *[None] * 6) for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(frame, marks)
    assert sorted(tuple(r) for r in got.collect()) == audit_brute(rows, labels)
    assert audit.filter_audit(frame.limit(0), marks).count() == 0


def test_audit_holds_few_parts_at_once(spark, monkeypatch):
    rows = [(i, f"text {i}", f"s{i % 40}") for i in range(80)]
    frame = spark.createDataFrame([(*r, *[None] * 6) for r in rows], DOCS).coalesce(1)
    monkeypatch.setattr(audit, "HELD_PARTS", 3)
    got = audit.filter_audit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == audit_brute(rows, [])
