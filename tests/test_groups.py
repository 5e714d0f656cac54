"""Profiles of many datasets in one table against profiles of each alone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom import Table
from tabloom.frame import CLASSIFICATION, REGRESSION
from tabloom.plans.groups import GROUPED, attach, grouped_profile
from tabloom.plans.profile import COUNTS, metafeature_values

SCHEMA = "id long, g string, y string, p double, q double, s string, `a.b c` string"


def many(n=900, seed=1) -> pd.DataFrame:
    """A hot dataset, two middling ones, one of a single row."""
    rng = np.random.default_rng(seed)
    g = rng.choice(["hot", "x", "y y"], n, p=[0.8, 0.12, 0.08])
    g[0] = "one"
    v = rng.normal(size=n)
    out = pd.DataFrame({"id": np.arange(n), "g": g, "y": rng.choice(["b", "a", "c"], n, p=[0.5, 0.4, 0.1]), "p": v, "q": v**2 + rng.random(n)})
    out["s"] = np.where(v > 0, "up", np.where(rng.random(n) < 0.3, "flat", "down"))
    out.loc[rng.random(n) < 0.2, "s"] = None
    out.loc[rng.random(n) < 0.2, "q"] = np.nan
    out["a.b c"] = [f"{a}{i % 7}" for i, a in enumerate(g)]
    return out


@pytest.mark.parametrize("task, rows_per_range", [(CLASSIFICATION, 10**6), (CLASSIFICATION, 5), (REGRESSION, 10**6)])
def test_every_dataset_as_alone(spark, task, rows_per_range):
    df = spark.createDataFrame(many().astype(object).where(lambda d: d.notna(), None), SCHEMA).repartition(5)
    label = "y" if task == CLASSIFICATION else "p"
    features = [n for n in ("p", "q", "s", "a.b c") if n != label]
    t = Table.of(df, "id", label, features, task)
    got = grouped_profile(t, "g", rows_per_range=rows_per_range).toPandas().set_index(["group", "name"])["value"]
    assert got.index.is_unique
    for g in ("hot", "x", "y y"):
        want = metafeature_values(t.where(F.col("g") == g), GROUPED)
        assert set(got[g].index) == set(want)
        for name, value in want.items():
            assert math.isclose(got[g, name], value, rel_tol=1e-8, abs_tol=1e-8), (g, name)
    assert got["one", "NumberOfInstances"] == 1


def test_no_rows_no_features_and_missing_groups(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert grouped_profile(Table.of(df, "id", "y", ["p", "s"], CLASSIFICATION), "g").count() == 0
    assert grouped_profile(Table.of(df, "id", "y", [], CLASSIFICATION), "g").count() == 0
    rows = spark.createDataFrame([(1, None, "a", 1.0, None, None, "u"), (2, None, None, None, None, "s", "u")], SCHEMA)
    got = grouped_profile(Table.of(rows, "id", "y", ["p", "q", "s"], CLASSIFICATION), "g", [*COUNTS, "SymbolsSum", "NumberOfClasses"])
    got = {r["name"]: r["value"] for r in got.where(F.col("group") == "NaN").collect()}
    assert (got["NumberOfInstances"], got["NumberOfMissingValues"], got["SymbolsSum"], got["NumberOfClasses"]) == (2, 3, 2, 2)


def test_salted_join_is_the_plain_one(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 500, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain, salted = attach(rows, table, ["k"]), attach(rows, table, ["k"], cells=10, salt=4)
    assert "__salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, plain.fillna(-1).collect())) == sorted(map(tuple, salted.fillna(-1).collect()))


def test_jobs_do_not_grow_with_the_datasets(spark):
    tracker = spark.sparkContext.statusTracker()
    used = []
    for k in (4, 100):
        df = spark.range(1200).select("id", (F.col("id") % k).alias("g"), (F.col("id") % 3).cast("string").alias("y"), F.sqrt("id").alias("p"), (F.col("id") % 5).cast("string").alias("s"))
        spark.sparkContext.setJobGroup(f"profile {k}", "")
        found = grouped_profile(Table.of(df, "id", "y", ["p", "s"], CLASSIFICATION), "g").collect()
        assert len({r["group"] for r in found}) == k
        used.append(len(tracker.getJobIdsForGroup(f"profile {k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert used[1] <= used[0] + 2
