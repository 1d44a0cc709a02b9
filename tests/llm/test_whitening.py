"""Whitening against numpy's eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from marketloom.llm import whitening
from marketloom.llm.queries import QUERIES
from marketloom.llm.whitening import whiten


def expected(vectors):
    """Ids, x, n, deviations as whole numbers, eigenvalues and eigenvectors, by falling eigenvalue."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = ((n * x - s) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in good], centred, n, deviation, e[::-1], u[:, ::-1]


def check(rows, vectors, components=32):
    ids, centred, n, deviation, e, u = expected(vectors)
    k = min(components, len(e))
    assert len(rows) == n * k and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] <= 1e-9
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    order = sorted(range(n), key=lambda i: ids[i])
    got = np.array([r["whitened"] for r in rows]).reshape(n, k)
    want = (centred @ u[:, :k] / np.sqrt(e[:k]))[order]
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-7
    assert [r["deviation"] for r in rows[::k]] == [deviation[i] for i in order]
    assert np.allclose([r["explained"] for r in rows[:k]], e[:k] / e.sum(), rtol=1e-9)
    assert {r["n"] for r in rows} == {n}


def test_query(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = QUERIES["op12_embedding_whitening"](spark, sf).collect()
    check(rows, vectors)


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "other", i) for i, v in vectors], "vec_id long, embedding array<double>, x string, id long")


def test_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(c) for c in rng.standard_normal(5) * [9, 5, 3, 2, 1]]) for i in range(40)]
    odd = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [math.nan] * 5), (93, [0.0, math.inf, 0.0, 0.0, 0.0])]
    rows = whiten(frame(spark, vectors + odd)).collect()
    check(rows, vectors)
    rows = whiten(frame(spark, vectors), components=2).collect()
    check(rows, vectors, 2)


def test_repeated_rows_and_ids_count_each_by_itself(spark):
    vectors = [(1, [1.0, 0.5]), (1, [1.0, 0.5]), (None, [-2.0, 1.0]), (4, [0.0, -3.0])]
    rows = whiten(frame(spark, vectors)).collect()
    assert len(rows) == 8 and {r["n"] for r in rows} == {4} and sum(r["vec_id"] is None for r in rows) == 2
    assert rows[0]["identity_error"] < 1e-9


def test_rows_in_a_smaller_space(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(a), float(b), float(a), 7.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-9, 9, (30, 2)))]
    rows = whiten(frame(spark, vectors)).collect()
    _, centred, n, _, e, u = expected(vectors)
    assert rows[0]["identity_error"] < 1e-9
    for c in (1, 2):
        got = np.array([r["whitened"] for r in sorted(rows, key=lambda r: r["vec_id"]) if r["component"] == c])
        want = centred @ u[:, c - 1] / np.sqrt(e[c - 1])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
    assert all(r["whitened"] == 0 and r["explained"] < 1e-12 for r in rows if r["component"] > 2)


def test_equal_eigenvalues_are_all_found(spark):
    axes = np.eye(6) * 3
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate([*axes, *-axes])]
    rows = whiten(frame(spark, vectors)).collect()
    assert len(rows) == 72 and rows[0]["identity_error"] < 1e-9
    assert np.allclose([r["explained"] for r in rows], 1 / 6)


def test_one_row_equal_rows_and_none(spark):
    for vectors in ([(1, [0.5, 2.0])], [(1, [0.5, 2.0]), (2, [0.5, 2.0])]):
        rows = whiten(frame(spark, vectors)).collect()
        assert len(rows) == 2 * len(vectors)
        assert all((r["whitened"], r["deviation"], r["explained"], r["identity_error"]) == (0, 0, 0, 0) for r in rows)
    assert whiten(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_ends_when_the_wanted_components_have_converged(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ALL_DIMENSIONS", 8)
    rng = np.random.default_rng(4)
    vectors = [(i, [float(c) for c in rng.standard_normal(40) * 60 * 0.6 ** np.arange(40)]) for i in range(300)]
    passes = []
    once = whitening.pass_over
    monkeypatch.setattr(whitening, "pass_over", lambda *a: passes.append(1) or once(*a))
    check(whiten(frame(spark, vectors), components=3).collect(), vectors, 3)
    assert len(passes) < 36


def test_sums_of_many_tasks_are_added_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_SUMS", 2)
    rng = np.random.default_rng(6)
    vectors = [(i, [float(c) for c in rng.standard_normal(4)]) for i in range(60)]
    check(whiten(frame(spark, vectors).repartition(7)).collect(), vectors)


def test_large_deviations_are_exact(spark):
    vectors = [(1, [3e7 / 64]), (2, [-1e7 / 64 + 0.02])]
    rows = whiten(frame(spark, vectors)).collect()
    assert sorted(r["deviation"] for r in rows) == sorted(expected(vectors)[3])
