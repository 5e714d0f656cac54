import re

import __spark_entry__ as entry


def test_flagship_returns_a_score(spark):
    scores = {r["metric"]: r["value"] for r in entry.entry(spark).collect()}
    assert set(scores) == {"accuracy", "balanced_accuracy"} and all(0 < v < 1 for v in scores.values())


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 170
    assert all(re.match(r"^[a-z][a-z0-9_]+$", n) for n in entry.queries())


def test_scans_read_only_the_columns_they_need(spark, sf):
    plan = entry.queries()["standard_scale"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "l_shipdate" not in plan


def test_no_global_sort_of_rows(spark, sf):
    for name in ("kfold_split", "train_test_split", "clf_gaussian_nb", "pipeline_graph", "kmeans_assign"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_raw_rows_are_ranked_range_by_range(spark):
    for name in ("kfold_split", "shuffle_rows", "stratified_kfold_split"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(" in plan and "__range" in plan, name
