"""Rank correlations and contingency counts of many pairs."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom import Table
from tabloom.plans import pairs as module
from tabloom.plans.columnstats import mutual_information, spearman
from tabloom.plans.pairs import Contingency, contingency, pair_entropies, rank_correlation


def uneven(n=6000, seed=3) -> pd.DataFrame:
    """Ties, gaps, a value that two thirds of the rows share, a constant, infinities."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n)
    out = pd.DataFrame({"id": np.arange(n), "v": v, "w": np.round(v + rng.normal(size=n), 1)})
    out["hot"] = np.where(rng.random(n) < 0.66, 5.0, v * 10)
    out["gap"] = np.where(rng.random(n) < 0.3, np.nan, v**3)
    out["flat"] = 2.0
    out["far"] = np.where(v > 2, np.inf, np.where(v < -2, -np.inf, v))
    return out


@pytest.mark.parametrize("rows_per_range, partitions", [(10**6, 1), (300, 7), (50, 3)])
def test_ranks_are_those_of_the_whole_column(spark, rows_per_range, partitions):
    pdf = uneven()
    names = ["v", "w", "hot", "gap", "flat", "far"]
    t = Table.of(spark.createDataFrame(pdf).repartition(partitions), "id", None, names)
    pairs = [*itertools.combinations(names, 2), ("v", "v")]
    got = {(r["a"], r["b"]): r["value"] for r in rank_correlation(t, pairs, rows_per_range).collect()}
    ranks = pdf[names].rank()
    assert len(got) == len(pairs)
    for a, b in pairs:
        want = 1.0 if a == b else ranks[a].corr(ranks[b])
        if "flat" in (a, b):
            assert got[a, b] is None
        else:
            assert np.isclose(got[a, b], want, atol=1e-12), (a, b)


def test_rows_move_twice_whatever_the_number_of_columns(spark):
    rng = np.random.default_rng(0)
    for p in (3, 12):
        pdf = pd.DataFrame(rng.normal(size=(5000, p)), columns=[f"c{i}" for i in range(p)])
        t = Table.of(spark.createDataFrame(pdf.assign(id=np.arange(5000))), "id", None, [f"c{i}" for i in range(p)])
        plan = rank_correlation(t, list(itertools.combinations(t.features, 2)))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapGroupsInArrow") == 2 and "Generate" not in plan


def test_no_rows_and_no_pairs(spark):
    empty = Table.of(spark.createDataFrame([], "id int, x double, y double, s string, u string"), "id", None)
    assert [tuple(r) for r in rank_correlation(empty, [("x", "y")]).collect()] == [("x", "y", None)]
    assert spearman(empty, []).count() == 0 and mutual_information(empty, []).count() == 0
    assert mutual_information(empty, [("s", "u")]).count() == 0
    missing = Table.of(spark.createDataFrame([(1, None, 2.0), (2, 1.0, None)], "id int, x double, y double"), "id", None)
    assert rank_correlation(missing, [("x", "y")]).first()["value"] is None


def texts(n=3000) -> pd.DataFrame:
    rng = np.random.default_rng(5)
    s = rng.choice(["a", "b", "", None], n, p=[0.7, 0.1, 0.1, 0.1])
    return pd.DataFrame({"s": s, "u": [f"k{i}" for i in rng.integers(0, 400, n)], "o": "one", "d e.f": np.where(s == "a", "x", "y")})


@pytest.mark.parametrize("cells, dense, characters", [(10**6, 65_536, 10**7), (50, 65_536, 10**7), (50, 4, 100), (10**6, 1, 10**7)])
def test_counts_are_the_same_with_any_limits(monkeypatch, cells, dense, characters):
    """Tables that spill, sort or start their levels anew count the same."""
    import pyarrow as pa

    monkeypatch.setattr(module, "CELLS", cells)
    monkeypatch.setattr(module, "DENSE", dense)
    monkeypatch.setattr(module, "LEVEL_CHARACTERS", characters)
    pdf = texts().fillna("NaN")
    held, parts = Contingency(4, [(0, 1), (0, 3), (2, 1), (1, None)]), []
    for start in range(0, len(pdf), 250):
        parts += list(held.add(pa.RecordBatch.from_pandas(pdf.iloc[start : start + 250], preserve_index=False)))
    parts += list(held.drain())
    got = pa.Table.from_batches(parts).to_pandas().groupby(["pair", "x", "y"])["n"].sum()
    names = list(pdf.columns)
    for k, (i, j) in enumerate(held.pairs):
        want = pdf.groupby([names[i], names[j]]).size() if j is not None else pdf.groupby([names[i]]).size()
        assert got[k].sum() == len(pdf) and len(got[k]) == len(want)
        for at, n in want.items():
            assert got[(k, *at) if j is not None else (k, at, "")] == n


def test_entropies_of_pairs(spark):
    pdf = texts()
    df = spark.createDataFrame(pdf.assign(id=np.arange(len(pdf))), "s string, u string, o string, `d e.f` string, id long")
    t = Table.of(df.repartition(5), "id", None, ["s", "u", "o", "d e.f"])
    pairs = list(itertools.combinations(t.features, 2))
    got = {(r["a"], r["b"]): r for r in pair_entropies(t, pairs).collect()}

    def h(*names):
        share = pdf.fillna("NaN").groupby(list(names)).size() / len(pdf)
        return float(-(share * np.log(share)).sum())

    for a, b in pairs:
        assert np.allclose([got[a, b]["hx"], got[a, b]["hy"], got[a, b]["hxy"]], [h(a), h(b), h(a, b)], atol=1e-12)
    values = {(r["a"], r["b"]): r["value"] for r in mutual_information(t, pairs).collect()}
    assert values["o", "d e.f"] == 0.0 and 0 < values["s", "d e.f"] < 1
    assert "Generate" not in contingency(df, [F.col("u"), F.col("o")], [(0, 1)])._jdf.queryExecution().optimizedPlan().toString()
