"""Whitening against plain numpy and exact fractions."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from railbird.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, n int, white string, i int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "own", 2) for i, v in vectors], SCHEMA).repartition(5)


def exact(x):
    """Covariance by fractions."""
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = len(s)
    return [[sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in x) / n for j in range(d)] for i in range(d)]


def test_against_plain(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.normal(size=12) * np.linspace(0.1, 2, 12) + 0.3).tolist()) for i in range(400)]
    good += [good[0], (None, good[1][1]), (5, [4e3] * 12), (6, [-0.5 / 1024] * 12)]
    bad = [(900, None), (901, []), (902, [None] + [1.0] * 11), (903, [float("nan")] + [1.0] * 11), (904, [float("inf")] + [1.0] * 11), (905, [1.0] * 13), (906, [1.0] * 5)]
    rows = w.whiten(frame(spark, good + bad)).collect()
    assert len(rows) == 8 * len(good) and {r.n for r in rows} == {len(good)}
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in good]
    v = np.array([[float(c) for c in r] for r in exact(x)])
    values, vectors = np.linalg.eigh(v)
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = sorted(sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x)
    assert sorted(int(r.deviation_exact) for r in rows if r.component == 1) == deviation
    assert all(r.deviation == int(r.deviation_exact) if r.deviation_exact < 2**63 else r.deviation is None for r in rows)
    centred = np.array(x, float) - np.array([float(Fraction(t, n)) for t in s])
    for k in range(1, 9):
        want = centred @ vectors[:, -k] / np.sqrt(values[-k])
        got = {}
        for r in rows:
            if r.component == k:
                got.setdefault(r.vec_id, []).append(r.whitened)
                assert r.explained == pytest.approx(values[-k] / np.trace(v), rel=1e-12)
        mine = np.array(sorted(sum(got.values(), [])))
        sign = 1 if np.allclose(mine, np.sort(want), atol=1e-7) else -1
        assert np.allclose(mine, np.sort(sign * want), atol=1e-7)
    assert max(r.identity_error for r in rows) < 1e-9


def test_far_entries_are_exact(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.integers(-(2**51), 2**51, 3)).astype(float).tolist()) for i in range(30)]
    d = w.fit(frame(spark, vectors).select("embedding"))
    x = [[int(c) * 1024 + 100_000 for c in v] for _, v in vectors]
    assert np.allclose(d["values"].astype(float), np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in exact(x)]))[::-1], rtol=1e-12)
    assert d["sums"] == [sum(c) for c in zip(*x, strict=True)]
    with pytest.raises(Exception, match="does not fit"):
        w.fit(frame(spark, [(1, [1e300, 1.0])]).select("embedding"))


def test_equal_eigenvalues(spark):
    """Six axes with the same spread: any basis will do, but a white one and the same for all rows."""
    vectors = [(i, [s * (1.0 if j == i % 6 else 0.0) + (3.0 * (i % 2) if j == 6 else 0.0) for j in range(8)]) for i in range(12) for s in (-1, 1)]
    rows = w.whiten(frame(spark, vectors)).collect()
    assert {r.component for r in rows} == set(range(1, 8))  # the last axis has no variance
    assert max(r.identity_error for r in rows) < 1e-12
    assert sum(r.explained for r in rows if r.vec_id == 0) / 2 == pytest.approx(1.0)


def test_edges(spark):
    assert w.whiten(frame(spark, [])).count() == 0
    assert w.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert w.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert w.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert w.whiten(frame(spark, [(1, [1.0]), (2, [2.0])])).count() == 2
    floats = spark.createDataFrame([("a", [0.1, 0.2]), ("b", [0.3, 0.9]), ("c", [0.7, 0.1])], "vec_id string, embedding array<float>")
    assert {r.vec_id for r in w.whiten(floats).collect()} == {"a", "b", "c"}
    assert w.whiten(floats.withColumn("component", F.lit(1))).columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def rotation(size, seed):
    q = np.random.default_rng(seed).normal(size=(size, size)).astype(np.longdouble)
    for _ in range(3):
        for i in range(size):
            for j in range(i):
                q[:, i] -= (q[:, i] @ q[:, j]) * q[:, j]
            q[:, i] /= np.sqrt(q[:, i] @ q[:, i])
    return q


@pytest.mark.parametrize(
    ("values", "most"),
    [
        (np.linspace(1, 50, 40), 1e-16),
        (np.concatenate([1 + np.arange(5) * 1e-9, [2, 3, 3, 3 + 1e-6, 7]]), 1e-9),
        (np.concatenate([np.full(6, 4.0), 4 + np.arange(1, 4) * 1e-12, [1, 1e-8, 2e-8]]), 1e-6),
        (10.0 ** -np.arange(14), 1e-5),
        (np.full(5, 3.0), 0),
    ],
)
def test_refined_eigenvectors(values, most):
    """Residuals in extended precision; single vectors where the gaps allow it, to the error that the matrix's own rounding leaves."""
    values = values.astype(np.longdouble)
    q = rotation(len(values), len(values))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = w.refined_eigenvectors(a)
    scale = values.max()
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-17
    assert np.abs(a @ x - x * e).max() < 1e-17 * scale
    assert np.abs(np.sort(e) - np.sort(values)).max() < 1e-17 * scale
    for v, u in zip(values, q.T, strict=True):
        if np.sort(np.abs(values - v))[1] > 0:
            assert 1 - np.abs(u @ x).max() < max(most, 1e-18)


def test_single_precision_alone_is_not_enough():
    """What the iteration adds: nine more digits."""
    q = rotation(30, 3)
    a = (q * np.linspace(1, 9, 30).astype(np.longdouble)) @ q.T
    a = (a + a.T) / 2
    raw = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    off = lambda x: np.abs(x.T @ a @ x - np.diag(np.diag(x.T @ a @ x))).max()
    assert off(raw) > 1e-7 and off(w.refined_eigenvectors(a)[1]) < 1e-16


def test_gram_is_exact():
    rng = np.random.default_rng(0)
    for most in (10, 2**19, 2**20, 2**45, 2**61):
        d = rng.integers(-most, most, (9000 if most < 2**30 else 40, 3))
        o = d.astype(object)
        assert (w.gram(d) == o.T @ o).all()
