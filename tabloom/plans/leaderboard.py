"""Scoring many candidate pipelines and ranking the runs."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window as W, functions as F

from tabloom.frame import Table
from tabloom.functions.rank import ROWS_PER_RANGE, running_total
from tabloom.operators.base import get_operator, operator_names
from tabloom.plans.contracts import Profile, accepts, needed, profile_table
from tabloom.plans.metrics import cross_validate, evaluate
from tabloom.plans.pipeline import Pipeline, PipelineSpec, Step
from tabloom.plans.trie import SCORE_SCHEMA, message_of, score_specs
from tabloom.sources.splits import train_test_split

# Fixed set: the learners a dataset's baseline consists of, each after impute_one_hot.
BASELINE_LEARNERS = (
    "clf_random_forest",
    "clf_extra_trees",
    "clf_xgb",
    "clf_linear_svc",
    "clf_logistic_regression",
    "clf_gradient_boosting",
    "clf_knn",
    "clf_decision_tree",
)


def evaluate_train_test(t: Table, spec: PipelineSpec, metric: str = "accuracy", train: float = 0.8, seed: int = 42) -> float:
    """Split by key hash, fit on one part, score the other."""
    fit_on, held = train_test_split(t, train, seed)
    return evaluate(metric, Pipeline(spec).fit(fit_on).transform(held))


def score_pipelines(
    t: Table,
    specs: dict[str, PipelineSpec],
    dataset: str,
    metric: str = "accuracy",
    concurrent: int = 2,
    folds: int | None = None,
    train: float = 0.8,
) -> DataFrame:
    """One row per candidate; a failing one keeps its message.

    Candidates are independent Spark jobs submitted from a few driver threads,
    which Spark shares fairly under ``spark.scheduler.mode=FAIR``.
    """

    def run(item):
        name, spec = item
        try:
            if folds:
                score = cross_validate(t, lambda part: Pipeline(spec).fit(part), metric, folds)
            else:
                score = evaluate_train_test(t, spec, metric, train)
            return (dataset, name, float(score) if score is not None else None, "ok", None)
        except Exception as error:  # noqa: BLE001 - reported in the table
            return (dataset, name, None, "failed", message_of(error))

    with ThreadPoolExecutor(concurrent) as pool:
        rows = list(pool.map(run, specs.items()))
    return t.df.sparkSession.createDataFrame(rows, SCORE_SCHEMA)


def baseline_specs(learners: Sequence[str] = BASELINE_LEARNERS) -> dict[str, PipelineSpec]:
    return {n: PipelineSpec.chain("impute_one_hot", n) for n in learners}


def baseline_leaderboard(t: Table, dataset: str, metric: str = "accuracy", learners=BASELINE_LEARNERS, **options) -> DataFrame:
    """Scores of the baseline learners; of those that ran, only positive ones count.

    A learner that failed keeps its row, with status and message and no score.
    """
    return score_specs(t, baseline_specs(learners), dataset, metric, **options).where(
        (F.col("status") != "ok") | (F.col("score") > 0)
    )


def score_vs_baselines(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per run: the share of its dataset's baseline scores it reaches.

    A dataset has one baseline score per learner, so its scores travel as one
    short array and no run-baseline pairs are formed. Learners without a score do not count.
    """
    base = baselines.where(F.col("score").isNotNull()).groupBy("dataset").agg(F.collect_list("score").alias("base"))
    reached = F.size(F.filter("base", lambda b: b <= F.col("score"))) / F.size("base")
    return runs.join(base, "dataset").select("dataset", "run", "score", reached.alias("reward"))


def best_pipeline(runs: DataFrame) -> DataFrame:
    """Best score per dataset; the later run wins a tie.

    A two-column maximum is partially aggregated before the shuffle, unlike a
    sort of every dataset's runs.
    """
    best = F.max(F.struct("score", "run")).alias("b")
    return runs.groupBy("dataset").agg(best).select("dataset", F.col("b.run").alias("run"), F.col("b.score").alias("score"))


def trailing_mean(runs: DataFrame, window: int = 100, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Mean of the last ``window`` scores per dataset, the current run included.

    Runs are numbered first; stretches of consecutive numbers are windowed apart
    from each other, each with the last runs of the stretch before it, so one
    large dataset does not end up in one task.
    """
    size = max(rows_per_range, window)
    placed = running_total(runs, ["run"], ["dataset"], out="__i", rows_per_range=rows_per_range)
    own = F.floor(F.col("__i") / size)
    tail = F.pmod("__i", F.lit(size)) > size - window
    homes = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    copies = placed.withColumn("__own", own).withColumn("__at", F.explode(homes))
    w = W.partitionBy("dataset", "__at").orderBy("__i").rowsBetween(-(window - 1), 0)
    done = copies.withColumn("trailing", F.avg("score").over(w)).where(F.col("__at") == F.col("__own"))
    return done.drop("__i", "__own", "__at")


def candidate_steps(
    profiles: dict[str, Profile], family: str, task: str | None, operators: Sequence[str] | None = None
) -> list[tuple[str, str]]:
    """(input, operator) pairs that the contracts allow and that would change something."""
    out = []
    for name, profile in profiles.items():
        for op in operators or operator_names(family):
            o = get_operator(op)
            if accepts(o.contract, profile, task) and needed(o.need, profile):
                out.append((name, op))
    return out


def union_spec(branches: Sequence[Sequence[str]], learner: str) -> PipelineSpec:
    """A learner on the union of several chains; what the chains have in common at their start is one branch."""
    numbers: dict[tuple[str, ...], int] = {(): 0}
    steps: list[Step] = []
    for branch in branches:
        for i in range(1, len(branch) + 1):
            at = tuple(branch[:i])
            if at not in numbers:
                numbers[at] = len(steps) + 1
                steps.append(Step(numbers[at], at[-1], (numbers[at[:-1]],)))
    return PipelineSpec((*steps, Step(len(steps) + 1, learner, tuple(numbers[tuple(b)] for b in branches))))


def sampled(specs: dict[str, PipelineSpec], most: int, seed: int = 42) -> dict[str, PipelineSpec]:
    """At most so many candidates, the same ones whatever the others are called or in which order they come."""
    drawn = sorted(specs, key=lambda n: hashlib.sha256(f"{seed}:{n}".encode()).digest())[:most]
    return {n: specs[n] for n in specs if n in set(drawn)}


def candidate_pipelines(
    t: Table, learners: Sequence[str], families: Sequence[str], per_family: dict[str, Sequence[str]], unions: bool = False
) -> dict[str, PipelineSpec]:
    """Chains that take at most one operator per family, in family order, then a learner.

    With ``unions`` also learners on the union of two chains neither of which continues the other.
    Whether the first step is legal is read off the table's profile; later steps
    are checked when they are fitted.
    """
    profile = profile_table(t)
    found: dict[str, PipelineSpec] = {}
    legal: list[tuple[str, ...]] = []
    choices = [[None, *per_family.get(f, ())] for f in families]
    for picked in itertools.product(*choices):
        chain = [p for p in picked if p]
        if chain:
            first = get_operator(chain[0])
            if not (accepts(first.contract, profile, t.task) and needed(first.need, profile)):
                continue
            legal.append(tuple(chain))
        for learner in learners:
            if not chain and not accepts(get_operator(learner).contract, profile, t.task):
                continue
            spec = PipelineSpec.chain(*chain, learner)
            found[spec.id] = spec
    for a, b in itertools.combinations(legal, 2) if unions else ():
        if a != b[: len(a)] and b != a[: len(b)]:
            for learner in learners:
                spec = union_spec((a, b), learner)
                found[spec.id] = spec
    return found


def search_pipelines(
    t: Table, specs: dict[str, PipelineSpec], dataset: str, metric: str = "accuracy", most: int | None = None, **options
) -> DataFrame:
    """Leaderboard over candidates (or ``most`` of them), best first; steps that they share are fitted once."""
    scores = score_specs(t, sampled(specs, most) if most else specs, dataset, metric, **options)
    return scores.orderBy(F.col("score").desc_nulls_last(), "pipeline")
