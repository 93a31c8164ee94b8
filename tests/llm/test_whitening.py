"""Whitening against numpy's dense eigenvectors: real vectors, equal eigenvalues, few dimensions, odd rows."""

import math
from collections import defaultdict

import numpy as np
import pytest

from maskwright.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, x int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "n", 1) for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(4)


def whole(vectors):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], dtype=object)


def compare(got, vectors, k=8, rtol=1e-6):
    x = whole(vectors)
    n, d = x.shape
    shifted = n * x - x.sum(axis=0)
    y = (shifted / n).astype(float)
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert len(by) == n and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    for i in range(n):
        assert by[i][1].n == n and by[i][1].deviation == int((shifted[i] ** 2).sum())
    z = np.array([[by[i][j + 1].whitened for j in range(k)] for i in range(n)])
    assert np.abs(np.cov(z.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-9 and got[0].identity_error < 1e-9
    np.testing.assert_allclose([by[0][j + 1].explained for j in range(k)], e[:k] / np.trace(cov), rtol=1e-9)
    return z, y @ q[:, :k] / np.sqrt(e[:k])


@pytest.mark.parametrize("seed, n, d", [(1, 300, 24), (2, 40, 8), (3, 25, 100)])
def test_against_dense_eigenvectors(spark, seed, n, d):
    rnd = np.random.default_rng(seed)
    vectors = rnd.standard_normal((n, d)) * np.linspace(3, 0.5, d) + rnd.standard_normal(d)
    z, want = compare(whitening.whiten(table(spark, vectors)).collect(), vectors)
    np.testing.assert_allclose(z * np.sign((z * want).sum(axis=0)), want, atol=1e-8)


def test_equal_eigenvalues_are_all_found(spark):
    corners = np.array([[s if i == j else 0.0 for j in range(12)] for i in range(12) for s in (-1.0, 1.0)])  # all 12 eigenvalues are alike
    compare(whitening.whiten(table(spark, corners)).collect(), corners)


def test_fewer_components_than_wanted(spark):
    rnd = np.random.default_rng(5)
    flat = np.hstack([rnd.standard_normal((50, 3)), np.zeros((50, 9))])
    z, want = compare(whitening.whiten(table(spark, flat)).collect(), flat, k=3)
    np.testing.assert_allclose(z * np.sign((z * want).sum(axis=0)), want, atol=1e-8)
    two = rnd.standard_normal((50, 2))
    compare(whitening.whiten(table(spark, two)).collect(), two, k=2)


def test_odd_rows(spark):
    rnd = np.random.default_rng(6)
    good = rnd.standard_normal((20, 3))
    odd = [None, [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [1.0, 2.0], [], [1e30, 0, 0]]
    got = whitening.whiten(table(spark, [*good, *odd])).collect()
    compare(got, good, k=3)
    same = whitening.whiten(table(spark, [good[0], good[0], good[1]], [None, None, 5])).collect()
    assert sorted(str(r.vec_id) for r in same) == ["5", "None", "None"] and len({r.whitened for r in same if r.vec_id is None}) == 1
    assert whitening.whiten(table(spark, [good[0]] * 5)).count() == 0
    assert whitening.whiten(table(spark, [None, []])).count() == 0
    assert whitening.whiten(table(spark, good).limit(0)).count() == 0


def test_exact_beyond_longs(spark):
    vectors = [[2.0**50, 0.0], [-(2.0**50), 1.0], [0.0, 5.0]]
    got = whitening.whiten(table(spark, vectors)).collect()
    assert {r.vec_id: r.deviation for r in got} == {0: None, 1: None, 2: 9216**2}
    assert all(r.identity_error < 1e-4 for r in got)
