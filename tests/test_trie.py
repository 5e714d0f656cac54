"""Shared steps of many pipelines: fits are counted, scores are those of single runs."""

from __future__ import annotations

import math

import pytest
from helpers import blobs
from pyspark.sql import functions as F

from tabloom.operators.base import Operator, register
from tabloom.plans.leaderboard import candidate_pipelines, evaluate_train_test, sampled, search_pipelines, union_spec
from tabloom.plans.metrics import cross_validate
from tabloom.plans.pipeline import Pipeline, PipelineSpec, Step
from tabloom.plans.trie import Trie, Walk, message_of, score_specs, walks
from tabloom.sources.splits import hash_of

CHAIN = PipelineSpec.chain
SPECS = {
    "a": CHAIN("impute_mean", "standard_scale", "clf_nearest_centroid"),
    "b": CHAIN("impute_mean", "standard_scale", "clf_lda"),
    "c": CHAIN("impute_mean", "minmax_scale", "clf_lda"),
    "same as b": CHAIN("impute_mean", "standard_scale", "clf_lda"),
    "two": union_spec([("impute_mean", "standard_scale"), ("impute_mean", "minmax_scale")], "clf_nearest_centroid"),
    "raw and scaled": PipelineSpec((Step(3, "impute_mean"), Step(5, "maxabs_scale", (3,)), Step(9, "clf_lda", (3, 5)))),
    "loose": PipelineSpec((Step(1, "robust_scale"), Step(2, "impute_mean"), Step(3, "clf_lda", (2,)))),
}


def test_equal_steps_are_one_node():
    trie = Trie(SPECS)
    names = sorted(s.operator for s in trie.steps.values())
    assert names == sorted(
        "impute_mean standard_scale minmax_scale maxabs_scale clf_nearest_centroid clf_nearest_centroid clf_lda clf_lda clf_lda clf_lda".split()
    )
    assert trie.last["b"] == trie.last["same as b"]
    other = Trie({"p": PipelineSpec((Step(1, "clf_knn", (0,), {"k": 1}),)), "q": PipelineSpec((Step(1, "clf_knn", (0,), {"k": 2}),))})
    assert len(other.steps) == 2


@pytest.mark.parametrize("folds", [None, 2])
def test_scores_are_those_of_single_runs_and_every_node_is_fitted_once(spark, folds):
    t, _, _ = blobs(spark, n=240, gap=1.0)
    trie = Trie(SPECS)
    done = walks(t, trie, "accuracy", folds=folds)
    for walk in done:
        assert sorted(walk.fits) == sorted(trie.steps) and not walk.failed
        assert set(walk.frames) == {0}
    for name, spec in SPECS.items():
        got = [w.outcome(name) for w in done]
        assert all(m is None for _, m in got)
        if folds:
            want = cross_validate(t, lambda part: Pipeline(spec).fit(part), "accuracy", folds)
        else:
            want = evaluate_train_test(t, spec)
        assert math.isclose(sum(s for s, _ in got) / len(got), want, abs_tol=1e-12), name


def test_kept_frames_hold_what_is_read_later_and_are_given_up(spark):
    t, _, _ = blobs(spark, n=120)
    kept = {}

    class Watched(Walk):
        def release(self, number):
            kept.update({n: r.table.df.columns for n, r in self.frames.items() if n})
            super().release(number)

    trie = Trie({k: SPECS[k] for k in ("a", "b", "c")})
    walk = Watched(trie, t, hash_of(t) % 5 == 0, "accuracy").run()
    by = {s.operator: n for n, s in trie.steps.items() if s.operator != "clf_lda"}
    assert set(kept) == {by["impute_mean"], by["standard_scale"]}
    # The raw features are not read behind the imputation, and the imputed ones not behind the scale.
    assert not any(n.startswith("__s0_") for n in kept[by["impute_mean"]])
    assert set(walk.frames) == {0}


def test_a_broken_step_takes_only_what_rests_on_it(spark):
    @register
    class Broken(Operator):
        name = "broken_for_test"

        def learn(self, t):
            raise ValueError("no such luck\nsecond line")

    t, _, _ = blobs(spark, n=120)
    specs = {"good": SPECS["a"], "bad": CHAIN("impute_mean", "broken_for_test", "clf_lda"), "none": CHAIN("no_such_operator")}
    rows = {r["pipeline"]: r for r in score_specs(t, specs, "d").collect()}
    assert rows["good"]["status"] == "ok" and rows["good"]["score"] > 0.5 and rows["good"]["message"] is None
    assert rows["bad"]["status"] == "failed" and rows["bad"]["message"] == "no such luck" and rows["bad"]["score"] is None
    assert rows["none"]["status"] == "failed"
    folded = {r["pipeline"]: r for r in score_specs(t, specs, "d", folds=2).collect()}
    assert folded["bad"]["message"] == "0: no such luck; 1: no such luck" and folded["good"]["status"] == "ok"
    assert score_specs(t, {}, "d").count() == 0


def test_lost_memory_is_not_a_score():
    with pytest.raises(MemoryError):
        message_of(MemoryError())
    with pytest.raises(RuntimeError):
        message_of(RuntimeError("java.lang.OutOfMemoryError: Java heap space"))


def test_candidates_with_two_inputs(spark):
    t, _, _ = blobs(spark, n=120)
    families = {"feature preprocess": ["standard_scale", "minmax_scale"], "feature selection": ["variance_threshold"]}
    chains = candidate_pipelines(t, ["clf_lda"], list(families), families)
    found = candidate_pipelines(t, ["clf_lda"], list(families), families, unions=True)
    two = {n: s for n, s in found.items() if n not in chains}
    assert chains.items() <= found.items() and all(len(s.steps[-1].inputs) == 2 for s in two.values())
    # Chains: s, m, v, sv, mv; pairs in which neither continues the other.
    assert len(two) == 8
    few = sampled(found, 4)
    assert len(few) == 4 and sampled(dict(reversed(found.items())), 4).keys() == few.keys()
    board = search_pipelines(t, two, "d", most=3).collect()
    assert len(board) == 3 and all(r["status"] == "ok" and r["score"] > 0.5 for r in board)
    assert [r["score"] for r in board] == sorted((r["score"] for r in board), reverse=True)
