"""Many pipelines over one table as one graph of shared steps.

Steps with the same operator, parameters and inputs are one node, whichever pipelines they come from.
A node is fitted once per fold, by the training rows of one frame that also holds the held-out rows.
The output of a node that several others read is kept (``persist``) with just the columns that are
read later, and given up when its last descendant is done. A node with several inputs goes on from the
kept frame that covers most of what it needs; fitted steps that are missing there are applied again, not
fitted. Nodes that no pipeline needs are not fitted.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table
from tabloom.functions.keys import MODULUS
from tabloom.operators.base import Fitted
from tabloom.plans.contracts import accepts, profile_table
from tabloom.plans.metrics import evaluate
from tabloom.plans.pipeline import ContractViolation, PipelineSpec, Running, Step
from tabloom.sources.splits import hash_of, kfold

SCORE_SCHEMA = "dataset string, pipeline string, score double, status string, message string"
HELD = "__held"


def message_of(error: Exception) -> str:
    """First line of an error that belongs to a candidate; lost memory is nobody's and goes on up."""
    if isinstance(error, MemoryError) or "OutOfMemoryError" in str(error):
        raise error
    return (str(error) or type(error).__name__).splitlines()[0][:500]


class Trie:
    """The distinct steps of several pipelines: ``steps`` by number from 1, ``last`` per pipeline."""

    def __init__(self, specs: dict[str, PipelineSpec]):
        self.steps: dict[int, Step] = {}
        self.last: dict[str, int] = {}
        numbers: dict[tuple, int] = {}
        for name, spec in specs.items():
            here = {0: 0}
            for step in self.read(spec):
                inputs = tuple(here[i] for i in step.inputs)
                same = (step.operator, json.dumps(step.params, sort_keys=True, default=repr), inputs)
                number = numbers.setdefault(same, len(numbers) + 1)
                self.steps.setdefault(number, Step(number, step.operator, inputs, step.params))
                here[step.index] = number
            self.last[name] = here[spec.steps[-1].index]
        self.readers: dict[int, list[int]] = {n: [] for n in (0, *self.steps)}
        for number, step in self.steps.items():
            for i in dict.fromkeys(step.inputs):
                self.readers[i].append(number)

    @staticmethod
    def read(spec: PipelineSpec) -> list[Step]:
        """The last step and whatever it rests on, in order."""
        needed, kept = {spec.steps[-1].index}, []
        for step in reversed(spec.steps):
            if step.index in needed:
                needed.update(step.inputs)
                kept.append(step)
        return kept[::-1]

    def below(self, numbers: Iterable[int]) -> set[int]:
        """The given nodes and all they rest on, the raw table left out."""
        found: set[int] = set()
        open_ = list(numbers)
        while open_:
            n = open_.pop()
            if n and n not in found:
                found.add(n)
                open_ += self.steps[n].inputs
        return found

    def above(self, number: int) -> set[int]:
        """All nodes that rest on this one."""
        found: set[int] = set()
        open_ = list(self.readers[number])
        while open_:
            n = open_.pop()
            if n not in found:
                found.add(n)
                open_ += self.readers[n]
        return found


class Walk:
    """Fits the nodes of a trie on the rows that are not held out and scores the pipelines on the others."""

    def __init__(self, trie: Trie, t: Table, held: Column, metric: str, concurrent: int = 2, check_contracts: bool = False):
        self.trie, self.metric, self.concurrent, self.check_contracts = trie, metric, concurrent, check_contracts
        start = replace(t, df=t.df.withColumn(HELD, held), carry=(*t.carry, HELD))
        self.frames: dict[int, Running] = {0: Running.start(start)}
        self.fitted: dict[int, Fitted] = {}
        self.failed: dict[int, str] = {}
        self.scores: dict[int, float | None] = {}
        self.waiting = {n: self.trie.above(n) for n in trie.steps}
        self.lock = threading.Lock()
        #: Nodes in the order of their fits.
        self.fits: list[int] = []

    def run(self) -> "Walk":
        try:
            self.children(0)
        finally:
            for number in [n for n in self.frames if n]:
                self.frames.pop(number).table.df.unpersist()
        return self

    def frame(self, inputs: Sequence[int]) -> Running:
        """Columns of the given nodes for all rows, from the kept frame that covers most of them."""
        needed = self.trie.below(inputs)
        with self.lock:
            kept = dict(self.frames)
        base = max((n for n in kept if n in needed or n == 0), key=lambda n: (len(self.trie.below([n])), n))
        run = kept[base]
        for n in sorted(needed - self.trie.below([base])):
            run = run.absorb(n, self.fitted[n].transform(run.view(self.trie.steps[n].inputs)))
        return run

    def children(self, number: int) -> None:
        ready = [n for n in self.trie.readers[number] if self.trie.steps[n].inputs and self.settled(n)]
        ends = [n for n in ready if not self.trie.readers[n]]
        if len(ends) > 1 and self.concurrent > 1:
            with ThreadPoolExecutor(self.concurrent) as pool:
                list(pool.map(self.visit, ends))
        else:
            for n in ends:
                self.visit(n)
        for n in ready:
            if self.trie.readers[n]:
                self.visit(n)

    def settled(self, number: int) -> bool:
        """All inputs are there, and nobody has been here."""
        done = self.fitted.keys() | self.failed.keys()
        return number not in done and all(i == 0 or i in done for i in self.trie.steps[number].inputs)

    def visit(self, number: int) -> None:
        step = self.trie.steps[number]
        lost = [self.failed[i] for i in step.inputs if i in self.failed]
        try:
            if lost:
                self.failed[number] = lost[0]
            else:
                self.fit(step)
        except Exception as error:  # noqa: BLE001 - kept with the pipelines that need the step
            self.failed[number] = message_of(error)
        if number in self.trie.last.values() and number not in self.failed:
            try:
                self.scores[number] = self.score(step)
            except Exception as error:  # noqa: BLE001 - as above; steps that rest on it are tried all the same
                self.scores[number], self.failed[-number] = None, message_of(error)
        self.children(number)
        self.release(number)

    def fit(self, step: Step) -> None:
        run = self.frame(step.inputs)
        view = run.view(step.inputs).where(~F.col(HELD))
        op = step.build()
        if self.check_contracts and not accepts(op.contract, profile_table(view), view.task):
            raise ContractViolation(f"step {step.index} ({op.name}) does not accept its input")
        fitted = op.fit(view)
        with self.lock:
            self.fits.append(step.index)
            self.fitted[step.index] = fitted
        if len(self.trie.readers[step.index]) > 1:
            inside = self.trie.below([step.index])
            later = {i for n, s in self.trie.steps.items() if n not in inside for i in s.inputs}
            whole = run.absorb(step.index, fitted.transform(run.view(step.inputs)))
            kept = whole.keep(later & (inside | {0}))
            kept.table.df.persist(StorageLevel.MEMORY_AND_DISK)
            with self.lock:
                self.frames[step.index] = kept

    def score(self, step: Step) -> float | None:
        """Only held-out rows go through the last step."""
        run = self.frame(step.inputs)
        run = replace(run, table=run.table.where(F.col(HELD)))
        run = run.absorb(step.index, self.fitted[step.index].transform(run.view(step.inputs)))
        return evaluate(self.metric, run.result(step.index))

    def release(self, number: int) -> None:
        """Frames without unfinished descendants are given up."""
        with self.lock:
            spent = []
            for n, waiting in self.waiting.items():
                waiting.discard(number)
                if not waiting and n in self.frames:
                    spent.append(self.frames.pop(n))
        for run in spent:
            run.table.df.unpersist()

    def outcome(self, name: str) -> tuple[float | None, str | None]:
        """Score and message of a pipeline."""
        number = self.trie.last[name]
        score = self.scores.get(number)
        lost = self.failed.get(number) or self.failed.get(-number)
        return (float(score) if score is not None else None), lost


def walks(
    t: Table, trie: Trie, metric: str, train: float = 0.8, folds: int | None = None, seed: int = 42, **options
) -> list[Walk]:
    """One walk over a train and test split by key hash, or one per contiguous fold."""
    if not folds:
        held = hash_of(t, seed) >= F.lit(int(train * MODULUS)) if train < 1 else F.lit(False)
        return [Walk(trie, t, held, metric, **options).run()]
    folded = kfold(t, folds)
    folded = replace(folded, df=folded.df.persist(StorageLevel.MEMORY_AND_DISK))
    try:
        return [Walk(trie, folded, F.col("fold") == i, metric, **options).run() for i in range(folds)]
    finally:
        folded.df.unpersist()


def score_specs(t: Table, specs: dict[str, PipelineSpec], dataset: str, metric: str = "accuracy", **options) -> DataFrame:
    """One row per pipeline: (dataset, pipeline, score, status, message).

    With folds the score is the mean over those that have one, and the message names the others. A pipeline
    without any score is "failed" and keeps the message of the step that broke; the others go on.
    """
    trie = Trie(specs)
    done = walks(t, trie, metric, **options) if specs else []
    rows = []
    for name in specs:
        outcomes = [w.outcome(name) for w in done]
        scores = [s for s, _ in outcomes if s is not None]
        lost = [f"{i}: {m or 'no score'}" if len(done) > 1 else m for i, (s, m) in enumerate(outcomes) if s is None]
        broken = not scores and any(m for _, m in outcomes)
        message = "; ".join(m for m in lost if m) or None
        rows.append((dataset, name, sum(scores) / len(scores) if scores else None, "failed" if broken else "ok", message))
    return t.df.sparkSession.createDataFrame(rows, SCORE_SCHEMA)
