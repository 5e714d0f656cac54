"""Linear learners fitted by repeated aggregates; transforms are affine expressions."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC as MlLinearSVC, LogisticRegression as MlLogistic
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table
from tabloom.functions.linear import affine, first_max
from tabloom.functions.stats import class_index, classes, number_columns, number_matrix, one_row
from tabloom.operators.base import register
from tabloom.operators.learner import Classifier
from tabloom.operators.newton import Problem, Solution, packed, solve, squared_hinge
from tabloom.operators.trees import IDX, VEC, indexed
from tabloom.sources.splits import kfold

CONCURRENT_FITS = 4


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


class _OneVsRest(Classifier):
    """One binary linear model per class (one in all for two classes).

    The class fits are independent Spark jobs over the same cached vectors and
    run side by side.
    """

    def binary(self, data: DataFrame, rows: int):
        """Return (coefficients, intercept) of label 1 against 0."""
        raise NotImplementedError

    def learn(self, t):
        labels = classes(t)
        data = indexed(t, labels).persist()
        try:
            rows = data.count()
            targets = [1] if len(labels) == 2 else list(range(len(labels)))

            def fit(k: int):
                return self.binary(data.select(VEC, (F.col(IDX) == k).cast("double").alias(IDX)), rows)

            with ThreadPoolExecutor(CONCURRENT_FITS) as pool:
                fits = list(pool.map(fit, targets))
        finally:
            data.unpersist()
        return {"labels": labels, "weights": [f[0] for f in fits], "bias": [f[1] for f in fits]}

    def margins(self, t: Table, state: dict) -> list[Column]:
        return affine([t.number(n) for n in t.features], np.array(state["weights"]), np.array(state["bias"]))

    def probabilities(self, margins: list[Column], labels: list) -> list[Column]:
        p = [sigmoid(m) for m in margins]
        if len(labels) == 2:
            return [1 - p[0], p[0]]
        total = p[0]
        for v in p[1:]:
            total = total + v
        return [v / total for v in p]

    def apply(self, t, state):
        return self.outputs(t, state["labels"], self.probabilities(self.margins(t, state), state["labels"]))

    def one_hot_apply(self, t: Table, state: dict) -> Table:
        m, labels = self.margins(t, state), state["labels"]
        if len(labels) == 2:
            chosen = F.when(m[0] > 0, F.lit(labels[1])).otherwise(F.lit(labels[0]))
        else:
            chosen = first_max(m, labels)
        return self.one_hot_outputs(t, labels, chosen)


def _coefficients(model) -> tuple[list[float], float]:
    return [float(v) for v in model.coefficients.toArray()], float(model.intercept)


@register
class LogisticRegression(_OneVsRest):
    """L2 penalty with C = 1, one class against the rest."""

    name = "clf_logistic_regression"
    title = "LogisticRegression"

    def penalty(self, rows: int) -> float:
        return 1.0 / (self.params.get("C", 1.0) * rows)

    def binary(self, data, rows):
        fit = MlLogistic(
            featuresCol=VEC, labelCol=IDX, regParam=self.penalty(rows), standardization=False, maxIter=100
        ).fit(data)
        return _coefficients(fit)


@register
class SgdLog(LogisticRegression):
    """Log loss with alpha = 1e-4; the same objective, solved to convergence."""

    name = "clf_sgd_log"
    title = "SGDClassifier"

    def penalty(self, rows):
        return self.params.get("alpha", 1e-4)


@register
class LinearSvc(_OneVsRest):
    """Squared hinge loss with C = 1, all classes in one set of passes; predictions only, as one-hot columns.

    The intercept is penalised like the weights. ``gradient`` in the state is the largest norm of a class's
    gradient over its norm at zero weights; a fit that ends above ``tolerance`` warns and has ``converged`` false.
    """

    name = "clf_linear_svc"
    title = "LinearSVC"

    def learn(self, t):
        labels = classes(t)
        targets = [1] if len(labels) == 2 else list(range(len(labels)))
        problems = [Problem(self.params.get("C", 1.0), -1, k) for k in targets]
        rows, mean, scale = standard(t)
        blocks = packed(t.df.select(*number_columns(t, t.features), class_index(t, labels).alias("k"), F.lit(0).alias("fold")).where("k is not null"), mean, scale)
        try:
            found = solve(blocks, rows, problems, mean, scale, squared_hinge, True, self.params.get("tolerance", 1e-6), self.params.get("max_steps", 100))
        finally:
            blocks.unpersist()
        return {"labels": labels, **original(found, mean, scale)}

    def apply(self, t, state):
        return self.one_hot_apply(t, state)


def standard(t: Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and deviations of the features in one aggregate; a constant feature has deviation 1."""
    aggregates = {f"{kind} {n}": how(t.number(n)) for n in t.features for kind, how in (("m", F.avg), ("s", F.stddev_pop))}
    row = one_row(t.df, {"n": F.count("*"), **aggregates})
    return row["n"], np.array([row[f"m {n}"] or 0.0 for n in t.features]), np.array([row[f"s {n}"] or 1.0 for n in t.features])


def original(found: Solution, mean: np.ndarray, scale: np.ndarray) -> dict:
    """State of a solution: weights and intercepts for features that are not standardised."""
    weights = found.weights[:, :-1] / scale
    bias = found.weights[:, -1] - weights @ mean
    return {"weights": weights.tolist(), "bias": bias.tolist(), "gradient": float(found.gradient.max()), "steps": found.steps, "converged": found.converged}


@register
class SvcRbf(_OneVsRest):
    """Approximate RBF machine: random Fourier features (Rahimi & Recht 2007).

    gamma = 1 / features. A linear machine of hinge loss on the cosine features gives the
    margin, and a logistic fit on the margin gives probabilities.
    """

    name = "clf_svc_rbf"
    title = "SVC"

    def binary(self, data, rows):
        fit = MlLinearSVC(
            featuresCol=VEC, labelCol=IDX, regParam=1.0 / rows, standardization=False, maxIter=100
        ).fit(data)
        return _coefficients(fit)

    def _wide(self, t: Table, draw: dict) -> Table:
        size = len(draw["shift"])
        angles = affine([t.number(n) for n in t.features], np.array(draw["w"]), np.array(draw["shift"]))
        # Materialise the angles as one array first, so that each is computed once.
        df = t.df.withColumn("__angle", F.array(*angles))
        scale = float(np.sqrt(2.0 / size))
        df = df.withColumn("__z", F.transform("__angle", lambda a: F.cos(a) * scale))
        names = {f"z{i}": F.get("__z", F.lit(i)) for i in range(size)}
        kept = replace(t, df=df)
        return kept.derive(names)

    def learn(self, t):
        p, size = len(t.features), self.params.get("components", 100)
        rng = np.random.default_rng(self.params.get("seed", 0))
        gamma = self.params.get("gamma", 1.0 / p)
        draw = {
            "w": (rng.standard_normal((size, p)) * np.sqrt(2 * gamma)).tolist(),
            "shift": rng.uniform(0, 2 * np.pi, size).tolist(),
        }
        z = self._wide(t, draw)
        state = super().learn(z)
        labels = state["labels"]
        margins = z.derive({f"m{i}": m for i, m in enumerate(self.margins(z, state))})
        calibrations = []
        data = margins.df.select(
            F.array(*[margins.number(n) for n in margins.features]).alias("m"), class_index(margins, labels).alias("k")
        ).persist()
        try:
            for i, k in enumerate([1] if len(labels) == 2 else range(len(labels))):
                calibrations.append(_platt(data.select(F.get("m", F.lit(i)).alias("x"), (F.col("k") == k).cast("double").alias("y"))))
        finally:
            data.unpersist()
        return {**state, "draw": draw, "calibration": calibrations}

    def apply(self, t, state):
        z = self._wide(t, state["draw"])
        margins = [m * F.lit(a) + F.lit(b) for m, (a, b) in zip(self.margins(z, state), state["calibration"])]
        return self.outputs(z, state["labels"], self.probabilities(margins, state["labels"]))


def _platt(data: DataFrame) -> tuple[float, float]:
    """Logistic fit of a class flag on one margin by Newton steps, one aggregate each."""
    a, b = 1.0, 0.0
    for _ in range(20):
        p = sigmoid(F.col("x") * F.lit(a) + F.lit(b))
        w, g = p * (1 - p), F.col("y") - p
        x = F.col("x")
        s = one_row(data, {"ga": F.sum(g * x), "gb": F.sum(g), "aa": F.sum(w * x * x), "ab": F.sum(w * x), "bb": F.sum(w)})
        h = np.array([[s["aa"] + 1e-6, s["ab"]], [s["ab"], s["bb"] + 1e-6]])
        step = np.linalg.solve(h, np.array([s["ga"], s["gb"]]))
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-6:
            break
    return a, b


@register
class LogisticRegressionCV(_OneVsRest):
    """C from 10 values in 1e-4..1e4 by 3-fold accuracy.

    All (C, fold, class) problems take their trust-region Newton steps in the same passes, and no pass makes a
    matrix of features by features. Features are standardised for the solver's sake; the penalty still acts on the
    original scale. ``gradient`` and ``converged`` in the state tell how the last fits ended.
    """

    name = "clf_logistic_regression_cv"
    title = "LogisticRegressionCV"
    grid = tuple(float(v) for v in np.logspace(-4, 4, 10))

    def learn(self, t):
        labels, folds = classes(t), 3
        grid = sorted(self.params.get("grid", self.grid))
        rows, mean, scale = standard(t)
        folded = kfold(t, folds)
        blocks = packed(folded.df.select(*number_columns(t, t.features), class_index(t, labels).alias("k"), "fold").where("k is not null"), mean, scale)
        targets = [1] if len(labels) == 2 else list(range(len(labels)))
        try:
            best = grid[0]
            if len(grid) > 1:
                problems = [Problem(c_, f, k) for c_ in grid for f in range(folds) for k in targets]
                # accuracy of the left-out fold does not need the last digits
                fits = solve(blocks, rows, problems, mean, scale, tolerance=self.params.get("search_tolerance", 1e-2))
                hits = self._fold_hits(blocks, problems, fits.weights, len(labels))
                best = max(grid, key=lambda c_: (hits[c_], -c_))
            final = [Problem(best, -1, k) for k in targets]
            found = solve(blocks, rows, final, mean, scale, tolerance=self.params.get("tolerance", 1e-6))
        finally:
            blocks.unpersist()
        return {"labels": labels, **original(found, mean, scale), "C": best}

    @staticmethod
    def _fold_hits(blocks: DataFrame, problems: list[Problem], fits: np.ndarray, classes_: int) -> dict[float, float]:
        """Mean left-out accuracy of every C in one pass."""
        held: dict[tuple[float, int], list] = {}
        for q, w in zip(problems, fits):
            held.setdefault((q.C, q.skip), []).append(w)
        width = fits.shape[1]

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for x, k, fold in zip(pdf["x"], pdf["k"], pdf["fold"]):
                    x, k, fold = np.frombuffer(x).reshape(-1, width), np.frombuffer(k, np.int32), np.frombuffer(fold, np.int32)
                    out = []
                    for (c_, f), w in held.items():
                        m = x[fold == f] @ np.array(w).T
                        guess = (m[:, 0] > 0).astype(int) if classes_ == 2 else m.argmax(axis=1)
                        out.append((c_, f, int((guess == k[fold == f]).sum()), len(guess)))
                    yield pd.DataFrame(out, columns=["c", "fold", "hit", "n"])

        sums = blocks.mapInPandas(count, "c double, fold int, hit bigint, n bigint").groupBy("c", "fold").agg(
            (F.sum("hit") / F.sum("n")).alias("acc")
        )
        return {r["c"]: r["acc"] or 0.0 for r in sums.groupBy("c").agg(F.avg("acc").alias("acc")).collect()}


@register
class PassiveAggressive(_OneVsRest):
    """Online hinge updates (PA-I, C = 1) with iterative parameter mixing.

    Every epoch each task runs over its rows from the shared weights; the task
    averages, weighted by rows, start the next epoch (McDonald et al. 2010).
    """

    name = "clf_passive_aggressive"
    title = "PassiveAggressiveClassifier"

    def learn(self, t):
        labels = classes(t)
        targets = [1] if len(labels) == 2 else list(range(len(labels)))
        p, bound = len(t.features), self.params.get("C", 1.0)
        xs = number_columns(t, t.features)
        data = t.df.select(*xs, class_index(t, labels).alias("k")).where("k is not null").persist()
        w = np.zeros((len(targets), p + 1))
        try:
            for _ in range(self.params.get("epochs", 5)):
                start = w.copy()

                def epoch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                    mine, seen = start.copy(), 0
                    for pdf in batches:
                        if not len(pdf):
                            continue
                        z = number_matrix(pdf, p)
                        z = np.hstack([z, np.ones((len(z), 1))])
                        signs = np.where(pdf["k"].to_numpy()[:, None] == np.array(targets), 1.0, -1.0)
                        norms = (z[:, :-1] ** 2).sum(axis=1)
                        for row, sign, norm in zip(z, signs, norms):
                            loss = np.maximum(0.0, 1 - sign * (mine @ row))
                            tau = np.minimum(bound, loss / norm) if norm > 0 else 0 * loss
                            mine += (tau * sign)[:, None] * row
                        seen += len(z)
                    if seen:
                        yield pd.DataFrame({"n": [seen], "w": [(mine * seen).ravel()]})

                parts = data.mapInPandas(epoch, "n bigint, w array<double>")
                cells = parts.select("n", F.posexplode("w").alias("i", "v")).groupBy("i").agg(
                    (F.sum("v") / F.sum("n")).alias("v")
                )
                mixed = np.zeros(w.size)
                for r in cells.collect():  # classes * features numbers
                    mixed[r["i"]] = r["v"]
                w = mixed.reshape(w.shape)
        finally:
            data.unpersist()
        return {"labels": labels, "weights": w[:, :-1].tolist(), "bias": w[:, -1].tolist()}

    def apply(self, t, state):
        return self.one_hot_apply(t, state)
