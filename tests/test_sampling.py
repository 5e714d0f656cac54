import math

import numpy as np
from pyspark.sql import functions as F

from tabloom import Table
from tabloom.operators.cluster import balanced_assign, balanced_kmeans
from tabloom.operators.sampling import balanced_undersample, priority_weights, sample_prioritized, sample_uniform
from tabloom.sources.splits import kfold, sample_cap, shuffle_rows, stratified_kfold, train_test_split
from tests.helpers import blobs, table


def rows(spark, n=1000, parts=6):
    df = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("usual").alias("y"), (F.col("id") % 97 + 1).cast("double").alias("p")
    )
    return Table.of(df.repartition(parts), "id", "y", ["p"], "classification")


def test_split_ignores_partitioning(spark):
    parts = [{r[0] for r in train_test_split(rows(spark, parts=n))[0].df.select("id").collect()} for n in (1, 7)]
    assert parts[0] == parts[1] and 740 < len(parts[0]) < 860
    whole, none = train_test_split(rows(spark), 1.0)
    assert whole.df.count() == 1000 and none.df.count() == 0


def test_folds_have_contiguous_balanced_sizes(spark):
    t = kfold(rows(spark, 1003), 5)
    sizes = {r["fold"]: (r["n"], r["a"], r["b"]) for r in t.df.groupBy("fold").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).collect()}
    assert [sizes[i][0] for i in range(5)] == [201, 201, 201, 200, 200]
    assert all(sizes[i][2] < sizes[i + 1][1] for i in range(4))
    s = stratified_kfold(rows(spark), 2).df.groupBy("y", "fold").count().collect()
    assert sorted(r["count"] for r in s) == [50, 50, 450, 450]


def test_permutation_and_cap(spark):
    placed = shuffle_rows(rows(spark)).toPandas()
    assert sorted(placed["position"]) == list(range(1000))
    first = set(placed[placed["position"] < 50]["id"])
    assert {r["id"] for r in sample_cap(rows(spark), 50).df.collect()} == first


def test_undersample_cuts_every_class_to_the_smallest(spark):
    for size in (10**6, 60):
        out = balanced_undersample(rows(spark), rows_per_range=size).df
        assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"rare": 100, "usual": 100}


def test_uniform_draws(spark):
    out = sample_uniform(rows(spark), 5000).toPandas()
    assert len(out) == 5000 and out["draw"].is_unique and out["id"].nunique() > 900


def test_prioritized_draws_follow_the_priority(spark):
    t = table(spark, [(1, 1.0), (2, 3.0), (3, 16.0)], "id int, m double")
    for slots in (1, 64):
        out = sample_prioritized(t, "m", 20000, alpha=1.0, beta=0.5, slots=slots).toPandas()
        assert len(out) == 20000
        share = out["id"].value_counts(normalize=True)
        assert np.allclose([share[1], share[2], share[3]], [0.05, 0.15, 0.8], atol=0.02)
        weight = out.groupby("id")["weight"].first()
        assert np.allclose(weight, [1.0, 3**-0.5, 16**-0.5])


def test_weights_lie_in_unit_interval_and_new_rows_get_the_top(spark):
    t = table(spark, [(1, 1.0), (2, None), (3, 4.0)], "id int, m double")
    w = {r["id"]: r for r in priority_weights(t, "m").collect()}
    assert all(0 < r["weight"] <= 1 for r in w.values()) and w[2]["probability"] == w[3]["probability"]


def test_groups_never_exceed_their_room(spark):
    t, x, _ = blobs(spark, n=203, p=2, gap=6.0)
    centres = x[:5]
    for size in (10**6, 20):
        out = balanced_assign(t, centres, rows_per_range=size).toPandas()
        assert sorted(out["id"]) == list(range(203)) and out["cluster"].value_counts().max() <= math.ceil(203 / 5)
    assigned, _ = balanced_kmeans(t, 4, max_iter=3)
    assert assigned.toPandas()["cluster"].value_counts().max() <= math.ceil(203 / 4)


def test_one_point_repeated_still_fills_groups_evenly(spark):
    t = table(spark, [(i, 1.0) for i in range(90)], "id int, a double")
    out = balanced_assign(t, np.array([[1.0], [5.0], [9.0]])).toPandas()
    assert out["cluster"].value_counts().tolist() == [30, 30, 30]


def test_wide_hash_takes_in_every_key_column_and_reaches_past_2_to_33(spark):
    from pyspark.sql import functions as F
    from tabloom.functions.keys import WIDE, wide_hash
    from tabloom.operators.sampling import draws

    df = spark.range(10_000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), (F.col("id") % 3).cast("int").alias("turn"))
    assert df.select(wide_hash(df, ["host", "turn"]).alias("h")).distinct().count() == 10_000
    far = spark.range(10).select((F.col("id") * 2147483647 + 5).alias("k"))
    assert far.select(wide_hash(far, ["k"])).distinct().count() == 10
    rows = 1 << 33
    places = [r.p for r in draws(spark, 4000).select(F.pmod("h", F.lit(rows)).alias("p")).collect()]
    assert WIDE > rows and sum(p > rows // 2 for p in places) > 1500 and max(places) > 0.99 * rows
