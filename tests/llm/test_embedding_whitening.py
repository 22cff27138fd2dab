"""Whitening against exact integers and numpy's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from attesta.llm import bidiagonal, embedding_whitening
from attesta.llm.common import prepared

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def table(spark, vectors):
    prepared(spark)
    return spark.createDataFrame([(k, v if v is None else [None if x is None else float(x) for x in v], None, "x")
                                  for k, v in enumerate(vectors)], SCHEMA)


def check(vectors, rows, most=32):
    """Compare with sums of exact fractions and a dense eigenproblem."""
    good = {k: [math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for k, v in enumerate(vectors)
            if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    n, x = len(good), np.array(list(good.values()), dtype=object)
    sums = x.sum(0)
    off = n * x - sums
    centred = np.array([[float(Fraction(int(c), n)) for c in row] for row in off])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(good)
    for i, v in enumerate(good):
        assert sorted(by[v]) == list(range(1, k + 1))
        assert {r["deviation"] for r in by[v].values()} == {int((off[i] * off[i]).sum())}
        assert {r["n"] for r in by[v].values()} == {n}
    w = np.array([[by[v][c]["whitened"] for c in range(1, k + 1)] for v in good])
    assert np.allclose([by[next(iter(good))][c]["explained"] for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-9)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-7
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-7
    want = centred @ directions[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        if all(abs(values[c] - values[o]) > 1e-6 * values[0] for o in range(len(values)) if o != c):
            sign = np.sign(w[:, c] @ want[:, c])
            assert np.abs(w[:, c] - sign * want[:, c]).max() < 1e-6


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(700, 40)) * np.linspace(0.1, 3, 40) + 5).tolist()
    vectors += [vectors[0]] * 300                                       # a third is one vector
    vectors += [None, [float("nan")] * 40, [float("inf")] + [0.0] * 39, [None] * 40, [0.0] * 39, []]
    rows = embedding_whitening.whiten(table(spark, vectors).repartition(7)).collect()
    check([v if v is not None and len(v) == 40 else None for v in vectors], rows)


def test_many_tasks_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(embedding_whitening, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 6)).tolist()
    check(vectors, embedding_whitening.whiten(table(spark, vectors).repartition(17), 4).collect(), 4)


def test_directions_without_variance_are_left_out(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    vectors = np.concatenate((x, np.ones((60, 2)), np.floor(64 * x[:, :1]) / 64), 1).tolist()
    rows = embedding_whitening.whiten(table(spark, vectors)).collect()
    assert max(r["component"] for r in rows) == 3
    check(vectors, rows)


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]])
def test_no_variance_no_rows(spark, vectors):
    assert embedding_whitening.whiten(table(spark, vectors)).collect() == []


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**40, 1.0], [-(2.0**40), 3.0], [2.0**39, 2.0], [2.0**50, 0.0]]
    rows = embedding_whitening.whiten(table(spark, vectors)).collect()
    assert {r["vec_id"] for r in rows} == {0, 1, 2} and {r["deviation"] for r in rows} == {None}


@pytest.mark.parametrize("make", [
    lambda rng: rng.normal(size=(64, 64)), lambda rng: np.eye(9), lambda rng: np.diag([3.0, 3, 1, 1, 0.5]),
    lambda rng: np.linalg.qr(rng.normal(size=(30, 30)))[0] @ np.diag([5.0] * 15 + [1.0] * 15),
    lambda rng: np.diag(10.0 ** -np.arange(12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]])
def test_solver_to_double_precision(make):
    r = make(np.random.default_rng(1))
    values, directions = bidiagonal.eigen(r)
    exact = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(values), exact, rtol=1e-9, atol=1e-13 * exact[0])
    assert np.abs(directions.T @ directions - np.eye(len(r))).max() < 1e-11
    assert np.abs(r.T @ (r @ directions) - directions * values).max() < 1e-13 * values[0]


def test_small_singular_values_keep_their_digits():
    # a bidiagonal matrix determines its singular values to high relative accuracy: the product is known
    a, b = 10.0 ** -np.arange(0, 30, 3), np.full(9, 1e-2)
    values = bidiagonal.dqds(a, b)
    assert np.isclose(np.log10(values).sum(), 2 * np.log10(a).sum(), rtol=1e-13)
