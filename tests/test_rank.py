import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabloom.frame import number
from tabloom.functions.rank import average_ranks, quantiles, range_by_order, range_edges, range_of, running_total
from tabloom.plans.columnstats import spearman
from tabloom import Table


def skewed(spark, n=2000, seed=1):
    """A third of the rows share one value."""
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.34, 7.0, rng.normal(0, 50, n).round(3))
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 3, n), "v": v, "w": rng.integers(1, 5, n)})
    return spark.createDataFrame(pdf).repartition(5), pdf


def test_range_of_counts_edges(spark):
    edges = [float(i) for i in range(200)]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 63.0, 64.0, 127.5, 199.0, 500.0)], "x double")
    for part in (edges, edges[:10], edges[:3], edges[:1], []):
        got = [r[0] for r in df.select(range_of(F.col("x"), part)).collect()]
        assert got == [int(np.searchsorted(part, x, side="right")) for (x,) in df.collect()]


def test_running_total_same_for_any_range_size(spark):
    df, pdf = skewed(spark)
    want = pdf.sort_values(["v", "id"]).assign(before=lambda d: d.groupby("g")["w"].cumsum() - d["w"])
    want = want.set_index("id")["before"].sort_index()
    for size in (10**6, 300, 50):
        got = running_total(df, ["v", "id"], ["g"], "w", rows_per_range=size).toPandas().set_index("id")["before"].sort_index()
        assert (got == want).all()


def test_running_total_stop_keeps_exactly_the_first(spark):
    df, pdf = skewed(spark)
    got = running_total(df, ["v", "id"], ["g"], stop_at=40, rows_per_range=100).toPandas()
    want = pdf.sort_values(["v", "id"]).groupby("g").head(40)
    assert set(got["id"]) == set(want["id"])


def test_running_total_orders_text(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "k string").repartition(7)
    got = running_total(df, ["k"], rows_per_range=60).toPandas()
    assert (got.sort_values("k")["before"].to_numpy() == np.arange(500)).all()


def test_quantiles_by_counting_equal_sorting(spark):
    df, pdf = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0]
    want = np.quantile(pdf["v"], probs)
    for limit in (10**6, 5):
        got = quantiles(df, {"v": number("v")}, probs, exact_distinct=limit)["v"]
        assert np.allclose(got, want)


def test_quantiles_of_missing_column(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "id int, v double")
    assert quantiles(df, {"v": number("v")}, [0.5])["v"] is None


def test_average_ranks_and_spearman(spark):
    df, pdf = skewed(spark)
    got = average_ranks(df, "v", rows_per_range=200).toPandas().set_index("value")["rank"]
    want = pdf["v"].rank()
    assert np.allclose(got.loc[pdf["v"]].to_numpy(), want.to_numpy())
    t = Table.of(df, "id", None, ["v", "w"])
    rho = spearman(t, [("v", "w")], rows_per_range=200).first()["value"]
    assert np.isclose(rho, pdf["v"].rank().corr(pdf["w"].rank()))


def test_a_hot_leading_value_is_cut_by_the_next_column(spark):
    """All rows share the first order column; ranges must still be small."""
    df = spark.range(1000).select(F.lit(1.0).alias("v"), F.col("id")).repartition(5)
    edges = range_edges(df, ["v", "id"], 20, 1000)
    assert len(edges) > 10
    sizes = df.groupBy(range_by_order(["v", "id"], edges).alias("r")).count().toPandas()["count"]
    assert sizes.max() < 200
    placed = running_total(df, ["v", "id"], rows_per_range=50).toPandas().sort_values("id")
    assert (placed["before"].to_numpy() == np.arange(1000)).all()
