import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm.whitening import leading_pairs, op11_whitening, sturm_counts, tridiagonal, whiten

KINDS = "vec_id long, embedding array<double>"


def brute(rows, count=16):
    """Exact sums, covariance and deviations with numpy's own eigenvectors; rows are (vec_id, embedding)."""
    x = {k: [math.floor(64 * c) + 1_000_000 for c in e] for k, (_, e) in enumerate(rows)}
    distinct = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(distinct), [sum(map(int, c)) for c in distinct.T]
    centred = (n * distinct - np.array(sums)) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:count], axes.T[::-1][:count]
    out = {}
    for k, v in x.items():
        gap = [n * a - s for a, s in zip(v, sums)]
        out[k] = (n, sum(g * g for g in gap), (np.array(gap) / n) @ axes.T / np.sqrt(np.maximum(values, 1e-300)))
    return out, values / np.trace(centred.T @ centred / n)


def by_row(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_query_against_numpy(spark, sf):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, explained = brute(rows)
    got = by_row(op11_whitening(spark, sf))
    assert len(got) == len(rows) and all(sorted(r) == list(range(1, 17)) for r in got.values())
    signs = None
    for k, (v, _) in enumerate(rows):
        n, deviation, scores = want[k]
        found = np.array([got[v][c].whitened for c in range(1, 17)])
        signs = np.sign(found * scores) if signs is None else signs
        assert {(r.n, r.deviation) for r in got[v].values()} == {(n, deviation)}
        np.testing.assert_allclose(found * signs, scores, rtol=1e-6, atol=1e-8)
        np.testing.assert_allclose([got[v][c].explained for c in range(1, 17)], explained, rtol=1e-9)
        assert {r.identity_error for r in got[v].values()} == {got[rows[0][0]][1].identity_error}
    assert got[rows[0][0]][1].identity_error < 1e-9


@pytest.mark.parametrize("kind", ["random", "cluster", "equal", "diagonal", "rank", "arrow", "one", "two", "zero", "wilkinson"])
def test_pairs_of_hard_matrices(kind):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    matrix = {
        "random": lambda: (lambda a: a @ a.T)(rng.normal(size=(40, 60))),
        "cluster": lambda: q @ np.diag(1 + 1e-9 * np.arange(40)) @ q.T,
        "equal": lambda: q @ np.diag([3.0] * 10 + [1.0] * 30) @ q.T,
        "diagonal": lambda: np.diag(rng.integers(0, 5, 40).astype(float)),
        "rank": lambda: (lambda a: a @ a.T)(rng.normal(size=(40, 3))),
        "arrow": lambda: np.diag(np.arange(40.0)) + np.eye(40)[0][:, None] + np.eye(40)[0][None, :],
        "one": lambda: np.array([[7.0]]),
        "two": lambda: np.array([[2.0, 1.0], [1.0, 2.0]]),
        "zero": lambda: np.zeros((5, 5)),
        "wilkinson": lambda: np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
    }[kind]()
    values, axes = leading_pairs(matrix, 16)
    size = max(1e-300, np.abs(matrix).max()) * len(matrix)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(matrix)[::-1][:16], atol=1e-14 * size)
    np.testing.assert_allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-12)
    np.testing.assert_allclose(matrix @ axes.T, axes.T * values, atol=1e-13 * size)


def test_tridiagonal_form_and_counts():
    a = np.random.default_rng(1).normal(size=(30, 30))
    a = a + a.T
    d, off, reflections = tridiagonal(a)
    q = np.eye(30)
    for v in reflections:
        q -= 2 * np.outer(q @ v, v)
    np.testing.assert_allclose(q.T @ a @ q, np.diag(d) + np.diag(off, 1) + np.diag(off, -1), atol=1e-12)
    at = np.linspace(-20, 20, 41)
    assert sturm_counts(d, off, at).tolist() == [(np.linalg.eigvalsh(a) < x).sum() for x in at]


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    fine = [(k, rng.normal(size=5).tolist()) for k in range(40)]
    fine += [fine[3], (None, fine[4][1]), (77, fine[5][1])]
    odd = [(1, None), (2, [nan] * 5), (3, [1.0, None, 0.0, 0.0, 0.0]), (4, [inf] * 5), (5, [])]
    other = [(900, [1.0, 2.0]), (901, [1.0, 2.0])]  # one distinct vector of its width: no spread at all
    frame = spark.createDataFrame(fine + odd + other, KINDS).repartition(3)
    for name in ("x", "n", "width", "whitened", "my col", "a.b"):
        frame = frame.withColumn(name, F.lit("x"))
    want, explained = brute(fine)
    got = whiten(frame).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got if r.n > 1) == sorted((v or -1, c) for v, _ in fine for c in range(1, 6))
    assert {(r.n, int(r.deviation)) for r in got if r.vec_id == 7} == {want[7][:2]}
    np.testing.assert_allclose(sorted({r.explained for r in got if r.vec_id == 7}, reverse=True), explained, rtol=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)
    single = [r for r in got if r.vec_id in (900, 901)]
    assert len(single) == 4 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.explained == 0 for r in single)
    assert whiten(frame.limit(0)).count() == 0
    # two directions only, and values beyond 64 bits
    flat = spark.createDataFrame([(k, [float(k), float(k * k), 0.0]) for k in range(20)], KINDS)
    assert {r.component: r.whitened is None for r in whiten(flat).collect()} == {1: False, 2: False, 3: True}
    far = whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e25, 1.0]), (3, [3.0, 2.0])], KINDS)).collect()
    assert len(far) == 6 and all(r.n == 3 for r in far)
