import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom import Table
from tabloom.frame import CLASSIFICATION
from tabloom.operators import information
from tabloom.operators.information import digamma, neighbour_information
from tabloom.operators.scores import SCORES


def psi(n):
    return -0.57721566490153286 + math.fsum(1 / k for k in range(1, n))


def brute(x, y, k=3):
    """The estimate by all pairs; NaN is missing."""
    keep = ~np.isnan(x)
    x, y = x[keep], y[keep]
    keep = np.array([(y == v).sum() > 1 for v in y], bool)
    x, y = x[keep], y[keep]
    if not len(x):
        return None
    total = 0.0
    for i in range(len(x)):
        own = np.flatnonzero(y == y[i])
        d = np.sort(np.abs(x[own[own != i]] - x[i]))
        r = d[min(k, len(d)) - 1]
        m = ((x > x[i] - r) & (x < x[i] + r)).sum() if r > 0 else (x == x[i]).sum()
        total += psi(min(k, len(d)) if r > 0 else (x[own] == x[i]).sum()) - psi(len(own)) - psi(m)
    return max(0.0, psi(len(x)) + total / len(x))


def frame(spark, columns, y):
    rows = [tuple([i, str(y[i])] + [None if np.isnan(v[i]) else float(v[i]) for v in columns]) for i in range(len(y))]
    names = [f"c{j}" for j in range(len(columns))]
    df = spark.createDataFrame(rows, "id long, y string, " + ", ".join(f"{n} double" for n in names))
    return Table.of(df, "id", "y", names, CLASSIFICATION)


def columns_of(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.choice(["a", "b", "c", "d"], n, p=[0.6, 0.3, 0.09, 0.01])
    moved = rng.normal(size=n) + 2 * (y == "b")
    gaps = np.where(rng.random(n) < 0.2, np.nan, moved)
    # continuous, gaps, integers with many ties, one hot value, constant, a copy of the class
    return [moved, gaps, np.round(moved), np.where(rng.random(n) < 0.5, 0.0, moved), np.ones(n), (y == "b") * 1.0], y


@pytest.mark.parametrize("rows_per_range,one", [(1_000_000, 4096), (37, 10), (5, 10)])
def test_any_ranges_give_the_estimate_of_all_pairs(spark, monkeypatch, rows_per_range, one):
    monkeypatch.setattr(information, "ONE_RANGE", one)
    columns, y = columns_of(400, 3)
    y[0] = "alone"
    got = {r.feature: r.score for r in neighbour_information(frame(spark, columns, y), rows_per_range=rows_per_range).collect()}
    for j, x in enumerate(columns):
        assert math.isclose(got[f"c{j}"], brute(x, y), rel_tol=1e-9, abs_tol=1e-9), j


def test_missing_columns_and_small_tables(spark):
    nan = np.full(4, np.nan)
    t = frame(spark, [nan, np.array([1.0, 2.0, 3.0, 4.0])], np.array(["a", "a", "b", "b"]))
    got = {r.feature: r.score for r in SCORES["mi_classif"](t, estimator="neighbours").collect()}
    assert got["c0"] is None and math.isclose(got["c1"], brute(np.array([1.0, 2.0, 3.0, 4.0]), np.array(["a", "a", "b", "b"])))
    assert [r.score for r in neighbour_information(t.with_df(t.df.limit(0))).collect()] == [None, None]
    with pytest.raises(ValueError):
        SCORES["mi_classif"](t, estimator="other")


def test_digamma(spark):
    got = spark.range(1, 300).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(math.isclose(r.p, psi(r.id), rel_tol=1e-13, abs_tol=1e-14) for r in got)


def test_estimate_of_a_known_distribution(spark):
    """Two uniform classes that overlap by half: ln 2 / 2."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    t = frame(spark, [rng.random(3000) + 0.5 * y], y)
    assert abs(neighbour_information(t).first().score - math.log(2) / 2) < 0.04
