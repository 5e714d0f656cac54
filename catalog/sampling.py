"""Samples and groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.registry import LINE_KEY, keys_sql, load, query, r6, rounded, text_part, wide_sql
from tabloom import Table
from tabloom.frame import CLASSIFICATION
from tabloom.operators.cluster import balanced_assign, balanced_kmeans, balanced_swaps, kmeans_assign, kmeans_score, kmeans_transform
from tabloom.operators.sampling import balanced_undersample, priority_weights, sample_prioritized, sample_uniform

K = keys_sql()
DRAW = wide_sql("range")


@query(
    "balanced_undersample",
    f"""WITH h AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {wide_sql('doc_id')}, doc_id) AS rn FROM labels)
    SELECT doc_id, quality FROM h WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""",
)
def q_undersample(spark, sf):
    t = Table.of(load(spark, sf, "labels"), "doc_id", "quality", ["toxic"], CLASSIFICATION)
    return balanced_undersample(t).df.select("doc_id", "quality")


@query(
    "balanced_undersample_ranges",
    f"""WITH h AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
                   ORDER BY {wide_sql('o_orderkey')}, o_orderkey) AS rn FROM orders)
    SELECT o_orderkey, o_orderstatus FROM h
    WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))""",
)
def q_undersample_ranges(spark, sf):
    """The same through many hash ranges, as for a table of billions of rows."""
    t = Table.of(load(spark, sf, "orders"), "o_orderkey", "o_orderstatus", ["o_totalprice"], CLASSIFICATION)
    return balanced_undersample(t, rows_per_range=700).df.select("o_orderkey", "o_orderstatus")


@query(
    "balanced_undersample_mixed_key",
    f"""WITH h AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY role ORDER BY {wide_sql(text_part("'host' || conv_id % 7"), 'turn', 'conv_id')}, conv_id, turn) AS rn FROM conversations)
    SELECT conv_id, turn, role FROM h WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM conversations GROUP BY role))""",
)
def q_undersample_mixed(spark, sf):
    """A key of text and integers: every column takes part in the hash."""
    df = load(spark, sf, "conversations").withColumn("host", F.concat(F.lit("host"), (F.col("conv_id") % 7).cast("string")))
    t = Table.of(df.drop("text"), ["host", "turn", "conv_id"], "role", [], CLASSIFICATION)
    return balanced_undersample(t).df.select("conv_id", "turn", "role")


@query(
    "sample_uniform",
    f"""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey, o_totalprice FROM orders),
    d AS (SELECT range AS draw, ({DRAW}) % (SELECT count(*) FROM orders) AS i FROM range(2000))
    SELECT draw, o_orderkey, o_totalprice FROM d JOIN o USING (i)""",
)
def q_uniform(spark, sf):
    t = Table.of(load(spark, sf, "orders"), "o_orderkey", features=[])
    return sample_uniform(t, 2000).select("draw", "o_orderkey", "o_totalprice")


# Whole-number priorities and alpha = 1 make all prefix sums exact.
PRIORITY = "floor(o_totalprice)"


@query(
    "sample_prioritized",
    f"""WITH o AS (SELECT o_orderkey, {PRIORITY} AS m, sum({PRIORITY}) OVER (ORDER BY o_orderkey) - {PRIORITY} AS start FROM orders),
    s AS (SELECT sum(m) AS t, min(m) AS least, count(*) AS n FROM o),
    d AS (SELECT range AS draw, CAST({DRAW} AS DOUBLE) / CAST(2147483647 AS DOUBLE) / CAST(2147483647 AS DOUBLE) * t AS x FROM range(2000), s)
    SELECT draw, o_orderkey, {r6('pow(m / t * n, -0.4e0) / pow(least / t * n, -0.4e0)', 'weight')}
    FROM d JOIN o ON x >= start AND x < start + m, s""",
)
def q_prioritized(spark, sf):
    t = Table.of(load(spark, sf, "orders").withColumn("m", F.floor("o_totalprice").cast("double")), "o_orderkey", features=[])
    return rounded(sample_prioritized(t, "m", 2000, alpha=1.0, beta=0.4).select("draw", "o_orderkey", "weight"))


@query(
    "priority_weights",
    f"""WITH o AS (SELECT o_orderkey, pow(o_totalprice, 0.6e0) AS m FROM orders),
    s AS (SELECT sum(m) AS t, min(m) AS least, count(*) AS n FROM o)
    SELECT o_orderkey, {r6('m / t * n', 'relative')}, {r6('pow(m / t * n, -0.4e0) / pow(least / t * n, -0.4e0)', 'weight')} FROM o, s""",
)
def q_weights(spark, sf):
    orders = load(spark, sf, "orders")
    t = Table.of(orders, "o_orderkey", features=[])
    w = priority_weights(t, "o_totalprice")
    return rounded(w.select("o_orderkey", (F.col("probability") * F.lit(orders.count())).alias("relative"), "weight"))


# Given centres over (quantity, discount * 500).
CENTRES = np.array([[10.0, 5.0], [25.0, 30.0], [40.0, 15.0]])
GAPS = [f"(pow(l_quantity - {a}, 2) + pow(l_discount * 500 - {b}, 2))" for a, b in CENTRES.tolist()]


def plane(spark, sf) -> Table:
    df = load(spark, sf, "lineitem").selectExpr(*LINE_KEY, "l_quantity AS a", "l_discount * 500 AS b")
    return Table.of(df, LINE_KEY, None, ["a", "b"])


@query(
    "kmeans_assign",
    f"""SELECT {K}, CASE WHEN {GAPS[0]} <= {GAPS[1]} AND {GAPS[0]} <= {GAPS[2]} THEN 0
    WHEN {GAPS[1]} <= {GAPS[2]} THEN 1 ELSE 2 END AS cluster FROM lineitem""",
)
def q_assign(spark, sf):
    return kmeans_assign(plane(spark, sf), CENTRES)


@query("kmeans_transform", f"SELECT {K}, {', '.join(r6(f'sqrt({g})', f'd{i}') for i, g in enumerate(GAPS))} FROM lineitem")
def q_transform(spark, sf):
    return rounded(kmeans_transform(plane(spark, sf), CENTRES))


@query("kmeans_score", f"SELECT {r6('-sum(least(' + ', '.join(GAPS) + ')) / count(*)', 'score')} FROM lineitem")
def q_score(spark, sf):
    t = plane(spark, sf)
    return rounded(kmeans_score(t, CENTRES).select((F.col("score") / t.df.count()).alias("score")))


@query(
    "balanced_kmeans_assign",
    """
    WITH d AS (SELECT o_orderkey, pow(o_totalprice / 1000 - 100, 2) AS d0, pow(o_totalprice / 1000 - 150, 2) AS d1 FROM orders),
    n AS (SELECT *, CASE WHEN d0 <= d1 THEN 0 ELSE 1 END AS near, ceil(count(*) OVER () / 2.0e0) AS cap FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY near ORDER BY least(d0, d1), o_orderkey) AS rn FROM n)
    SELECT o_orderkey, CASE WHEN rn <= cap THEN near ELSE 1 - near END AS cluster FROM r
    """,
)
def q_balanced_assign(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice / 1000 AS a")
    return balanced_assign(Table.of(df, "o_orderkey"), np.array([[100.0], [150.0]]), rows_per_range=2000)


@query("balanced_kmeans")
def q_balanced_kmeans(spark, sf):
    df = load(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice / 100000 AS a", "o_custkey / 1000 AS b")
    assigned, _ = balanced_kmeans(Table.of(df, "o_orderkey"), 4, max_iter=2)
    return assigned


_SWAP_GAPS = [f"pow(o_totalprice / 1000 - {m}, 2)" for m in (100, 150, 200)]


@query(
    "balanced_swap_round",
    f"""WITH d AS (SELECT o_orderkey, o_orderkey % 3 AS cl, {', '.join(f'{g} AS d{i}' for i, g in enumerate(_SWAP_GAPS))} FROM orders),
    o AS (SELECT o_orderkey, cl, unnest([0, 1, 2]) AS dest, unnest([d0, d1, d2]) AS g, [d0, d1, d2][cl + 1] AS own FROM d),
    b AS (SELECT o_orderkey, cl, dest, g - own AS loss, row_number() OVER (PARTITION BY o_orderkey ORDER BY g, dest) AS pick FROM o WHERE dest <> cl),
    r AS (SELECT *, row_number() OVER (PARTITION BY cl, dest ORDER BY loss, o_orderkey) AS place FROM b WHERE pick = 1)
    SELECT x.o_orderkey, CASE WHEN x.loss + y.loss < 0 THEN x.dest ELSE x.cl END AS cluster
    FROM r x LEFT JOIN r y ON x.cl = y.dest AND x.dest = y.cl AND x.place = y.place""",
)
def q_swap_round(spark, sf):
    """One round of swaps from an arbitrary balanced start."""
    df = load(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice / 1000 AS a")
    start = df.selectExpr("o_orderkey", "CAST(o_orderkey % 3 AS INT) AS cluster")
    return balanced_swaps(Table.of(df, "o_orderkey"), start, np.array([[100.0], [150.0], [200.0]]), rounds=1, rows_per_range=2000)
