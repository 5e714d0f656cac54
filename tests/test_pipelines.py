import pytest
from pyspark.sql import functions as F

from tabloom import Operator, Table, get_operator
from tabloom.operators.base import SchemaDrift, register
from tabloom.plans.leaderboard import (
    candidate_pipelines,
    evaluate_train_test,
    score_pipelines,
    trailing_mean,
)
from tabloom.plans.metrics import cross_validate, evaluate, fold_scores
from tabloom.plans.pipeline import ContractViolation, Pipeline, PipelineSpec, Step, pipeline_summary, redundant_steps, step_tables
from tests.helpers import blobs, collect, table


# A fifth of ``mixed`` has no value for the one telling column and is right only
# by chance: the best possible accuracy is about 0.9.
def mixed(spark, n=120):
    rows = [(i, "ab"[i % 2], None if i % 5 == 0 else float(i % 2) + 0.001 * i, None if i % 7 == 0 else "xyz"[i % 3]) for i in range(n)]
    return table(spark, rows, "id int, y string, v double, s string", label="y")


DIAMOND = PipelineSpec(
    (Step(1, "impute_mean", (0,)), Step(2, "one_hot", (0,)), Step(3, "standard_scale", (1, 2)), Step(4, "clf_lda", (3,)))
)


def test_diamond_runs_without_a_join(spark):
    t = mixed(spark)
    out = Pipeline(DIAMOND).fit(t).transform(t)
    assert "Join" not in out.df._jdf.queryExecution().optimizedPlan().toString()
    assert evaluate("accuracy", out) >= 0.85 and len(collect(out.df, "id")) == 120


def test_spec_round_trip_and_validation():
    assert PipelineSpec.from_json(DIAMOND.to_json()) == DIAMOND
    assert DIAMOND.id == "impute_mean0one_hot0standard_scale1_2clf_lda3"
    with pytest.raises(ValueError):
        PipelineSpec((Step(1, "one_hot", (2,)),))


def test_added_step_leaves_earlier_fits_alone(spark):
    p = Pipeline(PipelineSpec.chain("impute_one_hot")).fit(mixed(spark))
    before = p.fitted[1]
    p.add_step(Step(2, "clf_gaussian_nb", (1,)))
    assert p.fitted[1] is before and evaluate("accuracy", p.output()) >= 0.85
    assert [s.index for s in p.remove_last().spec.steps] == [1]


def test_drift_and_contracts_raise(spark):
    t = mixed(spark)
    p = Pipeline(PipelineSpec.chain("impute_mean")).fit(t)
    with pytest.raises(SchemaDrift):
        p.transform(t.pick(["v"]))
    with pytest.raises(ContractViolation):
        Pipeline(PipelineSpec.chain("standard_scale"), check_contracts=True).fit(t)


def test_failures_stay_in_the_leaderboard(spark):
    t = mixed(spark)
    specs = {"good": PipelineSpec.chain("impute_one_hot", "clf_lda"), "bad": PipelineSpec.chain("no_such_operator")}
    rows = {r["pipeline"]: r for r in score_pipelines(t, specs, "d").collect()}
    assert rows["good"]["status"] == "ok" and rows["bad"]["status"] == "failed" and rows["bad"]["message"]


def test_evaluation_and_folds(spark):
    t, _, _ = blobs(spark)
    spec = PipelineSpec.chain("standard_scale", "clf_nearest_centroid")
    assert evaluate_train_test(t, spec) > 0.9
    assert cross_validate(t, lambda part: Pipeline(spec).fit(part), "accuracy") > 0.9

    def broken(part):
        raise RuntimeError("no fit")

    assert [r["message"] for r in fold_scores(t, broken, "accuracy", 2)] == ["no fit"] * 2
    assert cross_validate(t, broken, "accuracy", 2) is None


def test_graph_questions(spark):
    loose = PipelineSpec((*DIAMOND.steps, Step(5, "minmax_scale", (1,))))
    steps, edges = step_tables(spark, {"p": loose, "q": PipelineSpec.chain("clf_lda")})
    summary = {r["pipeline"]: r for r in pipeline_summary(steps).collect()}
    assert summary["p"]["steps"] == 5 and summary["p"]["ratio"] == 0.25 and summary["q"]["ratio"] == -1.0
    assert redundant_steps(steps, edges).select("pipeline", "step").collect() == [("p", 5)]


def test_candidates_are_legal_chains(spark):
    t, _, _ = blobs(spark)
    found = candidate_pipelines(t, ["clf_lda"], ["data preprocess", "feature preprocess"], {"data preprocess": ["impute_mean"], "feature preprocess": ["standard_scale"]})
    assert sorted(found) == ["clf_lda0", "standard_scale0clf_lda1"]


def test_trailing_mean_is_the_same_in_stretches(spark):
    runs = spark.range(700).select(F.lit("d").alias("dataset"), F.col("id").alias("run"), (F.col("id") * 37 % 101).cast("double").alias("score"))
    want = runs.toPandas().sort_values("run")["score"].rolling(100, min_periods=1).mean().tolist()
    for size in (10**6, 150):
        got = trailing_mean(runs, rows_per_range=size).toPandas().sort_values("run")["trailing"]
        assert len(got) == 700 and abs(got.to_numpy() - want).max() < 1e-9


def test_user_operators_can_be_registered(spark):
    @register
    class Halve(Operator):
        name = "halve_for_test"
        family = "feature preprocess"
        contract = "c_t"

        def columns(self, t, state):
            return {f"{n}_half": t.number(n) / 2 for n in t.features}

    t = table(spark, [(1, 4.0)], "id int, x double")
    assert Pipeline(PipelineSpec.chain("halve_for_test")).fit(t).transform(t).df.first()["x_half"] == 2.0


def test_carried_columns_pass_through(spark):
    t = Table.of(spark.createDataFrame([(1, 2.0, "n")], "id int, x double, note string"), "id", features=["x"])
    from dataclasses import replace

    out = get_operator("minmax_scale").fit_transform(replace(t, carry=("note",)))
    assert out.df.columns == ["id", "note", "x_mnmxscale"]
