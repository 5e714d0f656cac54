"""Scans, splits and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import HASH_SQL, chained, load, orders, query, r6, rounded, text_part, wide_sql
from tabloom import Table
from tabloom.frame import c
from tabloom.sources.readers import read_dataset_paths, read_table
from tabloom.sources.sinks import only_new, pipeline_id
from tabloom.sources.splits import kfold, sample_cap, shuffle_rows, stratified_kfold, train_test_split

H = HASH_SQL.format(key="o_orderkey")
WIDE_H = wide_sql("o_orderkey")
MIXED = [text_part("'host' || conv_id % 7"), "turn", "conv_id"]


@query("read_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment AS target FROM customer")
def q_read_table(spark, sf):
    t = read_table(spark, f"{sf}/customer.parquet", key="c_custkey")
    return t.df.select(*[c(k) for k in t.key], *[c(f) for f in t.features], c(t.label).alias("target"))


@query(
    "read_dataset_dir",
    """
    SELECT 'nation' AS dataset, count(*) AS row_count, 1 AS features, count(DISTINCT n_regionkey) AS classes FROM nation
    UNION ALL SELECT 'region', count(*), 0, count(DISTINCT r_name) FROM region
    UNION ALL SELECT 'supplier', count(*), 2, count(DISTINCT s_acctbal) FROM supplier
    UNION ALL SELECT 'labels', count(*), 1, count(DISTINCT toxic) FROM labels
    """,
)
def q_read_dataset_dir(spark, sf):
    keys = {"nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "labels": "doc_id"}
    parts = []
    for name, key in keys.items():
        t = read_dataset_paths(spark, [f"{sf}/{name}.parquet"], key=key)[name]
        parts.append(
            t.df.agg(F.count("*").alias("row_count"), F.count_distinct(c(t.label)).alias("classes")).select(
                F.lit(name).alias("dataset"), "row_count", F.lit(len(t.features)).alias("features"), "classes"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("shuffle_rows", f"SELECT o_orderkey, row_number() OVER (ORDER BY {WIDE_H}, o_orderkey) - 1 AS position FROM orders")
def q_shuffle_rows(spark, sf):
    return shuffle_rows(orders(spark, sf)).select("o_orderkey", F.col("position").cast("bigint").alias("position"))


def mixed(spark, sf) -> Table:
    """Conversation turns under a key of text and integers, with few hosts."""
    df = load(spark, sf, "conversations").withColumn("host", F.concat(F.lit("host"), (F.col("conv_id") % 7).cast("string")))
    return Table.of(df.drop("text"), ["host", "turn", "conv_id"], "role", [])


@query("split_mixed_key", f"SELECT conv_id, turn, ({chained(MIXED)[0]}) < 1717986917 AS train FROM conversations")
def q_split_mixed(spark, sf):
    train, test = train_test_split(mixed(spark, sf))
    parts = [p.df.select("conv_id", "turn", F.lit(flag).alias("train")) for p, flag in ((train, True), (test, False))]
    return parts[0].unionByName(parts[1])


@query(
    "shuffle_mixed_key",
    f"SELECT conv_id, turn, row_number() OVER (ORDER BY {wide_sql(*MIXED)}, 'host' || conv_id % 7, turn, conv_id) - 1 AS position FROM conversations",
)
def q_shuffle_mixed(spark, sf):
    return shuffle_rows(mixed(spark, sf)).select("conv_id", "turn", F.col("position").cast("bigint").alias("position"))


@query(
    "sample_cap",
    f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY {WIDE_H}, o_orderkey LIMIT 1500",
)
def q_sample_cap(spark, sf):
    return sample_cap(orders(spark, sf), 1500).df.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "train_test_split",
    f"""
    SELECT o_orderkey, CASE WHEN {H} < 1717986917 THEN 'train' ELSE 'test' END AS part FROM orders
    """,
)
def q_train_test_split(spark, sf):
    train, test = train_test_split(orders(spark, sf))
    return train.df.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        test.df.select("o_orderkey", F.lit("test").alias("part"))
    )


@query("kfold_split", "SELECT o_orderkey, (ntile(5) OVER (ORDER BY o_orderkey) - 1)::INTEGER AS fold FROM orders")
def q_kfold(spark, sf):
    return kfold(orders(spark, sf)).df.select("o_orderkey", "fold")


@query(
    "stratified_kfold_split",
    """
    SELECT o_orderkey, o_orderstatus,
           (ntile(2) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::INTEGER AS fold FROM orders
    """,
)
def q_stratified(spark, sf):
    return stratified_kfold(orders(spark, sf)).df.select("o_orderkey", "o_orderstatus", "fold")


@query(
    "write_run_log",
    """
    WITH steps AS (
      SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN '0' ELSE (turn - 1)::VARCHAR || '_' || turn::VARCHAR END AS ins
      FROM conversations),
    ids AS (SELECT conv_id, count(*) AS n, string_agg(role || ins, '' ORDER BY turn) AS id FROM steps GROUP BY conv_id),
    stored AS (SELECT DISTINCT id FROM ids WHERE n <= 2)
    SELECT id, min(n) AS steps FROM ids WHERE id NOT IN (SELECT id FROM stored) GROUP BY id
    """,
)
def q_write_run_log(spark, sf):
    """Conversations as step chains: a chain is logged only if its id is new."""
    turn = F.col("turn").cast("int")
    inputs = F.when(turn == 0, F.array(F.lit(0))).otherwise(F.array(turn - 1, turn))
    steps = load(spark, sf, "conversations").select(
        "conv_id", F.struct(turn.alias("index"), F.col("role").alias("name"), inputs.alias("inputs")).alias("step")
    )
    chains = steps.groupBy("conv_id").agg(F.collect_list("step").alias("steps"))
    ids = chains.select(pipeline_id(F.col("steps")).alias("id"), F.size("steps").cast("bigint").alias("steps"))
    return only_new(ids, ids.where("steps <= 2"), ["id"])


@query(
    "baseline_score_cache",
    f"""
    WITH s AS (SELECT c_mktsegment AS dataset, c_nationkey AS learner, {r6('avg(c_acctbal) / 10000')} AS score,
                      min(c_acctbal) AS low FROM customer GROUP BY 1, 2)
    SELECT dataset, learner, score FROM s WHERE NOT low < 0
    """,
)
def q_baseline_cache(spark, sf):
    """Mean balances stand in for scores; pairs already stored (any negative balance) are not stored again."""
    customer = load(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("dataset"), F.col("c_nationkey").alias("learner"), "c_acctbal"
    )
    scores = customer.groupBy("dataset", "learner").agg((F.avg("c_acctbal") / 10000).alias("score"))
    stored = customer.where("c_acctbal < 0").select("dataset", "learner").distinct()
    return rounded(only_new(scores, stored, ["dataset", "learner"]))
