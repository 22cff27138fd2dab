"""Embedding links against all pairs: none wrong, and nearly all of them found."""

import numpy as np
import pytest

from attesta.llm import projection_forest
from attesta.llm.common import prepared

SCHEMA = "vec_id long, embedding array<float>, label int, core string"


def table(spark, vectors, ids=None):
    prepared(spark)
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 1, "x")
                                  for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def brute(vectors):
    """Links and smallest reachable index of every vector, by all pairs."""
    good = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and bool(np.any(v)) for v in vectors]
    n, group = [0] * len(vectors), list(range(len(vectors)))
    for dim in {len(v) for v, g in zip(vectors, good) if g}:
        at = [i for i, g in enumerate(good) if g and len(vectors[i]) == dim]
        x = np.array([np.float32(vectors[i]) for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= 0.95
        np.fill_diagonal(linked, False)
        label = np.arange(len(at))
        while True:
            new = np.minimum(label, np.where(linked, label, len(at)).min(1))
            if (new == label).all():
                break
            label = new
        for k, i in enumerate(at):
            n[i], group[i] = int(linked[k].sum()), at[label[k]]
    return n, group


def copies(rng, centre, k, noise):
    x = centre + rng.normal(size=(k, len(centre))) * noise
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


def compare(vectors, rows, recall):
    n, group = brute(vectors)
    got = {r["vec_id"]: r for r in rows}
    assert len(rows) == len(vectors) and set(got) == set(range(len(vectors)))
    assert all(got[i]["n_links"] <= n[i] for i in got)
    assert sum(r["n_links"] for r in rows) >= recall * sum(n)
    split = sum(got[i]["component_id"] != group[i] for i in got)
    assert split <= (1 - recall) * len(vectors)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    # never joined beyond the true components
    for i in got:
        assert group[got[i]["component_id"]] == group[i]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    units = rng.normal(size=(1500, 64))
    out = (units / np.linalg.norm(units, axis=1, keepdims=True)).tolist()
    for k, noise in ((2, 0.015), (2, 0.02), (3, 0.01), (40, 0.015), (90, 0.02), (700, 0.01), (260, 0.026)):
        out += copies(rng, rng.normal(size=64) / 8, k, noise)
    out += [out[0]] * 400 + [[2 * x for x in out[1]]]                      # very many equal ones; another length
    out += [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [1.0] * 63]
    out += copies(rng, np.array([1.0, 2.0, 3.0]), 6, 0.02) + copies(rng, np.ones(63) / 8, 3, 0.01)
    return out


@pytest.mark.parametrize("sample, leaf, block", [(16_384, 512, 512), (500, 64, 32), (100, 40, 16)])
def test_links_equal_all_pairs(spark, vectors, monkeypatch, sample, leaf, block):
    monkeypatch.setattr(projection_forest, "SAMPLE", sample)
    rows = projection_forest.link(table(spark, vectors).repartition(5), leaf=leaf, block=block).collect()
    # in small leaves a group too wide for a core (noise 0.026) is cut by its own medians
    compare(vectors, rows, 0.99 if leaf == 512 else 0.9)


def test_pairs_at_the_threshold(spark):
    """Pairs just above 0.95 in a table of many leaves: at least nine of ten by themselves."""
    rng = np.random.default_rng(9)
    out = []
    for _ in range(600):
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        out += [a.tolist(), (0.951 * a + np.sqrt(1 - 0.951**2) * b).tolist(), (0.949 * a - np.sqrt(1 - 0.949**2) * b).tolist()]
    rows = projection_forest.link(table(spark, out), leaf=48).collect()
    compare(out, rows, 0.95)
    assert sum(r["n_links"] for r in rows) > 0


def test_small_and_odd_tables(spark):
    assert projection_forest.link(table(spark, [])).collect() == []
    for vectors in ([None], [[]], [[1.0]], [[1.0], [-1.0], [2.0]], [[1.0, 0.0]] * 3, [[1e-30, 0.0], [1e30, 1e20]]):
        compare(vectors, projection_forest.link(table(spark, vectors)).collect(), 1.0)


def test_repeated_and_null_ids(spark):
    rows = projection_forest.link(table(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0], [5.0, 5.0]],
                                        [7, 7, None, 3, None])).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows], key=str) == sorted([
        (7, 1, 7, True), (7, 1, 7, True), (None, 1, 3, None), (3, 1, 3, True), (None, 0, None, None)], key=str)
