"""Chains and graphs of operators over one DataFrame.

The outputs of all steps live side by side in a single frame, so a step with
several inputs selects columns; branches never have to be joined back, and
columns that nobody reads are pruned by the optimizer.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.frame import Table, c
from tabloom.operators.base import Fitted, Operator, SchemaDrift, get_operator
from tabloom.operators.prepare import sanitize_name
from tabloom.plans.contracts import accepts, profile_table

# Fixed order of the families; the last three hold the estimators.
FAMILIES = (
    "data preprocess",
    "feature preprocess",
    "feature selection",
    "feature engineering",
    "Classifier",
    "Regressor",
    "ensemble",
)
ESTIMATORS = FAMILIES[-3:]


@dataclass(frozen=True)
class Step:
    """``index`` counts from 1; input 0 is the raw table."""

    index: int
    operator: str
    inputs: tuple[int, ...] = (0,)
    params: dict = field(default_factory=dict, hash=False, compare=False)

    def build(self) -> Operator:
        return get_operator(self.operator, **self.params)


@dataclass(frozen=True)
class PipelineSpec:
    steps: tuple[Step, ...]

    def __post_init__(self):
        seen = {0}
        for s in self.steps:
            if s.index in seen:
                raise ValueError(f"step {s.index} occurs twice")
            unknown = [i for i in s.inputs if i not in seen]
            if unknown or not s.inputs:
                raise ValueError(f"step {s.index} ({s.operator}) needs inputs that come later or do not exist: {unknown}")
            seen.add(s.index)

    @staticmethod
    def chain(*operators: str) -> "PipelineSpec":
        return PipelineSpec(tuple(Step(i + 1, name, (i,)) for i, name in enumerate(operators)))

    @property
    def id(self) -> str:
        return "".join(s.operator + "_".join(str(i) for i in s.inputs) for s in self.steps)

    def to_json(self) -> str:
        return json.dumps(
            [{"index": s.index, "operator": s.operator, "inputs": list(s.inputs), "params": s.params} for s in self.steps]
        )

    @staticmethod
    def from_json(text: str) -> "PipelineSpec":
        return PipelineSpec(
            tuple(Step(s["index"], s["operator"], tuple(s["inputs"]), s["params"]) for s in json.loads(text))
        )

    def with_step(self, step: Step) -> "PipelineSpec":
        return PipelineSpec((*self.steps, step))

    def without_last(self) -> "PipelineSpec":
        return PipelineSpec(self.steps[:-1])


class ContractViolation(ValueError):
    """A step's input does not meet its operator's acceptance contract."""


@dataclass
class Running:
    """One frame with the columns of all steps, and where each step's are."""

    table: Table
    features: dict[int, tuple[str, ...]]
    predictions: dict[int, str]

    @staticmethod
    def start(t: Table) -> "Running":
        physical = [f"__s0_{i}" for i in range(len(t.features))]
        df = t.df.select(*[c(n) for n in t.roles], *[c(n).alias(p) for n, p in zip(t.features, physical)])
        table = replace(t, df=df, features=(), carry=(*t.carry, *physical))
        return Running(table, {0: t.features}, {})

    def physical(self, step: int) -> list[str]:
        return [f"__s{step}_{i}" for i in range(len(self.features[step]))]

    def view(self, inputs: Sequence[int]) -> Table:
        """Union of the inputs' columns under their own names; names seen before are dropped."""
        chosen: dict[str, str] = {}
        for at, i in enumerate(inputs):
            pairs = list(zip(self.features[i], self.physical(i)))
            if at:
                pairs.sort()
            for name, column in pairs:
                chosen.setdefault(name, column)
        if len(inputs) > 1 or any(sanitize_name(n) != n for n in chosen):
            clean: dict[str, str] = {}
            for name, column in chosen.items():
                clean.setdefault(sanitize_name(name), column)
            chosen = clean
        df = self.table.df.select(
            *[c(n) for n in self.table.roles], *[c(p).alias(n) for n, p in chosen.items()]
        )
        return replace(self.table, df=df, features=tuple(chosen), prediction=None)

    def absorb(self, step: int, out: Table) -> "Running":
        physical = [f"__s{step}_{i}" for i in range(len(out.features))]
        kept = [c(n) for n in self.table.roles]
        added = [c(n).alias(p) for n, p in zip(out.features, physical)]
        carry = [*self.table.carry, *physical]
        predictions = dict(self.predictions)
        if out.prediction:
            predictions[step] = f"__p{step}"
            added.append(c(out.prediction).alias(f"__p{step}"))
            carry.append(f"__p{step}")
        table = replace(self.table, df=out.df.select(*kept, *added), carry=tuple(carry))
        return Running(table, {**self.features, step: out.features}, predictions)

    def keep(self, steps: Iterable[int]) -> "Running":
        """Only the columns of the given steps (0 is the raw table)."""
        kept = set(steps)
        lost = {p for s in self.features if s not in kept for p in self.physical(s)}
        lost |= {p for s, p in self.predictions.items() if s not in kept}
        table = replace(self.table, carry=tuple(n for n in self.table.carry if n not in lost))
        return Running(
            replace(table, df=table.df.select(*[c(n) for n in table.roles])),
            {s: f for s, f in self.features.items() if s in kept},
            {s: p for s, p in self.predictions.items() if s in kept},
        )

    def result(self, last: int) -> Table:
        out = self.view([last])
        if last in self.predictions:
            df = out.df.withColumn("prediction", c(self.predictions[last]))
            out = replace(out, df=df, prediction="prediction")
        keep = replace(out, carry=())
        return replace(keep, df=keep.df.select(*[c(n) for n in [*keep.roles, *keep.features]]))


class Pipeline:
    """Fits a spec step by step; adding a step fits only that step."""

    def __init__(self, spec: PipelineSpec, check_contracts: bool = False):
        self.spec = spec
        self.check_contracts = check_contracts
        self.fitted: dict[int, Fitted] = {}
        self._train: Running | None = None

    def fit(self, t: Table) -> "Pipeline":
        self._train, self.fitted = Running.start(t), {}
        for step in self.spec.steps:
            self._fit_step(step)
        return self

    def add_step(self, step: Step) -> "Pipeline":
        self.spec = self.spec.with_step(step)
        if self._train is not None:
            self._fit_step(step)
        return self

    def remove_last(self) -> "Pipeline":
        self.fitted.pop(self.spec.steps[-1].index, None)
        self.spec = self.spec.without_last()
        return self

    def _fit_step(self, step: Step) -> None:
        view = self._train.view(step.inputs)
        op = step.build()
        if self.check_contracts and not accepts(op.contract, profile_table(view), view.task):
            raise ContractViolation(f"step {step.index} ({op.name}) does not accept its input")
        self.fitted[step.index] = op.fit(view)
        self._train = self._train.absorb(step.index, self.fitted[step.index].transform(view))

    def output(self, step: int | None = None) -> Table:
        """Training output of a step (the last by default)."""
        return self._train.result(step if step is not None else self.spec.steps[-1].index)

    def transform(self, t: Table) -> Table:
        if tuple(t.features) != tuple(self._train.features[0]):
            raise SchemaDrift(f"fitted on {self._train.features[0]}, got {t.features}")
        run = Running.start(t)
        for step in self.spec.steps:
            run = run.absorb(step.index, self.fitted[step.index].transform(run.view(step.inputs)))
        return run.result(self.spec.steps[-1].index)


# Graph questions on stored specs: one row per step, one row per input.


def step_tables(spark: SparkSession, specs: dict[str, PipelineSpec]) -> tuple[DataFrame, DataFrame]:
    """(pipeline, step, operator, family) and (pipeline, step, input)."""
    steps, edges = [], []
    for name, spec in specs.items():
        for s in spec.steps:
            steps.append((name, s.index, s.operator, s.build().family))
            edges += [(name, s.index, i) for i in s.inputs]
    return (
        spark.createDataFrame(steps, "pipeline string, step int, operator string, family string"),
        spark.createDataFrame(edges, "pipeline string, step int, input int"),
    )


def pipeline_summary(steps: DataFrame) -> DataFrame:
    """Steps in all and per family, estimators, preprocessors, and their ratio (-1 without preprocessors)."""
    per = [F.sum((F.col("family") == f).cast("int")).alias(f.replace(" ", "_")) for f in FAMILIES]
    estimators = F.sum(F.col("family").isin(*ESTIMATORS).cast("int"))
    rest = F.count("*") - estimators
    return steps.groupBy("pipeline").agg(
        F.count("*").alias("steps"),
        *per,
        estimators.alias("estimators"),
        rest.alias("preprocessors"),
        F.when(rest > 0, estimators / rest).otherwise(-1.0).alias("ratio"),
    )


def redundant_steps(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps outside the estimator families whose output nobody reads."""
    used = edges.select("pipeline", F.col("input").alias("step")).distinct()
    return steps.where(~F.col("family").isin("Classifier", "Regressor")).join(used, ["pipeline", "step"], "left_anti")
