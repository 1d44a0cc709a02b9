import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm.neighbours import Tree, inner, nearest
from tests.llm.helpers import odd_docs  # noqa: F401


def brute(vectors, asks, k=20):
    out = set()
    ids = sorted(vectors)
    matrix = np.array([vectors[i] for i in ids], float)
    for q in ids:
        if asks(q):
            s = inner(np.array([vectors[q]], float), matrix)[0]
            order = [(-s[j], ids[j]) for j in range(len(ids)) if ids[j] != q]
            out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(sorted(order)[:k])}
    return out


def rows(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


def test_factor_one_is_exact(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    want = brute(vectors, lambda i: i % 20 == 0)
    assert rows(nearest(table, F.col("id") % 20 == 0, factor=1.0, shard_rows=90, query_rows=7)) == want
    found = rows(nearest(table, F.col("id") % 20 == 0))
    assert len({x[::2] for x in found} & {x[::2] for x in want}) >= 0.95 * len(want)


def test_recall_grows_with_the_factor():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(4000, 8)) + rng.integers(0, 6, 4000)[:, None]
    tree, queries = Tree(points, 32), rng.normal(size=(50, 8)) + 2
    exact = np.argsort(-inner(queries, points), axis=1)[:, :10]
    recalls = []
    for factor in (0.0, 0.1, 0.3, 1.0):
        _, row = tree.search(queries, np.full(50, -1), 10, factor)
        recalls.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(row, exact)]))
    assert recalls == sorted(recalls) and recalls[-1] == 1.0 and recalls[0] < 1.0


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0])]
    data += [(6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (40, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [2.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, rank string")
    found = rows(nearest(table, F.col("id") % 20 == 0))
    twos = {(q, r, 2, 2.0) for q in (0, 20) for r in (1, 2)}  # both rows of id 2 are candidates
    assert found == twos | {(0, 3, 1, 1.0), (0, 4, 20, 1.0), (20, 3, 0, 1.0), (20, 4, 1, 1.0)}
    assert nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0


def test_recall_of_every_hundredth_row(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no larger tables")
    table = spark.read.parquet(path)
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    want = brute(vectors, lambda i: i % 100 == 0)
    found = rows(nearest(table, F.col("id") % 100 == 0, shard_rows=500))
    assert len(found) == len(want) and len({x[::2] for x in found} & {x[::2] for x in want}) >= 0.9 * len(want)


def test_rows_that_repeat_an_id(spark):
    data = [(40, [1.0, 0.0]), (40, [0.0, 1.0]), (40, [1.0, 0.0]), (7, [2.0, 3.0])]
    got = sorted(tuple(r) for r in nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("id") == 40, shard_rows=2, factor=1.0).collect())
    # each of the three rows asks, and its own row alone is left out
    assert got == sorted([(40, 1, 7, 2.0), (40, 2, 40, 1.0), (40, 3, 40, 0.0)] * 2 + [(40, 1, 7, 3.0), (40, 2, 40, 0.0), (40, 3, 40, 0.0)])


def test_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 20
    centres *= 40 / np.linalg.norm(centres, axis=1)[:, None]
    points = {i: (centres[i % 12] + rng.normal(size=6) * 0.1).tolist() for i in range(900)}
    table = spark.createDataFrame(list(points.items()), "vec_id long, embedding array<double>")
    want = brute(points, lambda i: i % 20 == 0)
    assert rows(nearest(table, F.col("id") % 20 == 0, factor=1.0, shard_rows=50, pivots=30)) == want
    found = rows(nearest(table, F.col("id") % 20 == 0, shard_rows=50, pivots=30))
    assert len({x[::2] for x in found} & {x[::2] for x in want}) >= 0.9 * len(want)


def test_many_equal_vectors(spark):
    table = spark.createDataFrame([(i, [0.1, 0.2, 0.3]) for i in range(700)], "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id) for r in nearest(table, F.col("id") == 40, shard_rows=200).collect())
    assert got == [(k + 1, k) for k in range(20)]


def visited(tree, queries, k, factor):
    """Leaves that a search looks into, of all leaves."""
    leaves, seen = [], set()

    def walk(node):
        if isinstance(node, np.ndarray):
            leaves.append(node)
        else:
            walk(node[2])
            walk(node[3])

    walk(tree.root)
    for q in queries:
        before = inner
        looked = []
        globals_ = Tree.search.__globals__
        globals_["inner"] = lambda a, b: looked.append(len(b)) or before(a, b)
        try:
            tree.search(q[None, :], np.array([-1]), k, factor)
        finally:
            globals_["inner"] = before
        seen.add(len(looked))
    return len(leaves), seen


def test_inner_nodes_are_visited_and_prune():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(16, 8)) * 9
    points = centres[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 8)) * 0.3
    leaves, looked = visited(Tree(points, 64), points[:40], 10, 0.5)
    assert leaves > 30 and max(looked) < leaves and min(looked) < leaves / 4


def test_shards_hold_whole_trees_and_queries_are_dealt_to_several_tasks(spark, sf, monkeypatch):
    from marketloom.llm import neighbours

    monkeypatch.setattr(neighbours, "CELL_ROWS", 250)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    tree = Tree(np.array([v for v in vectors.values() if v is not None and None not in v], float))
    assert not isinstance(tree.root, np.ndarray)
    want = brute(vectors, lambda i: i % 20 == 0)
    assert rows(nearest(table, F.col("id") % 20 == 0, factor=1.0, slot_queries=4)) == want


def test_few_rows_of_a_leaf_are_scored_coordinate_by_coordinate(monkeypatch):
    from marketloom.llm import neighbours

    rng = np.random.default_rng(9)
    points = rng.normal(size=(4000, 32))  # random directions, where leaves are not pruned
    points[3000:3100] = points[0]  # equal rows tie to the last bit and come by their places
    want = inner(points[:60], points)
    want[np.arange(60), np.arange(60)] = -np.inf
    order = np.argsort(-want, axis=1, kind="stable")[:, :20]
    scored = []
    monkeypatch.setattr(neighbours, "inner", lambda a, b: scored.append(len(a) * b.shape[-2]) or inner(a, b))
    for floor in (None, np.take_along_axis(want, order, 1)[:, -1]):
        scored.clear()
        score, row = Tree(points).search(points[:60], np.arange(60), 20, 1.0, floor)
        assert (row == order).all() and (score == np.take_along_axis(want, order, 1)).all()
        assert sum(scored) < 0.2 * 60 * 4000
