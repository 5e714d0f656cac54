"""Recursive elimination: drop the weakest feature until half are left."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tabloom.frame import Table
from tabloom.functions.stats import class_index, classes, moments, one_row
from tabloom.operators.base import register
from tabloom.operators.select import Selector
from tabloom.operators.trees import IDX, VEC, vector


class _Eliminate(Selector):
    def target(self, t: Table) -> Table:
        return t

    def strengths(self, t: Table) -> np.ndarray:
        raise NotImplementedError

    def learn(self, t):
        keep = list(t.features)
        order = []
        kept = t.pick(keep)
        rows = kept.df.persist()  # features and label only; every round fits on them
        try:
            while len(keep) > max(1, len(t.features) // 2):
                values = self.strengths(kept.with_df(rows).pick(keep))
                weakest = keep[int(np.argmin(values))]
                order.append(weakest)
                keep.remove(weakest)
        finally:
            rows.unpersist()
        return {"keep": keep, "dropped": order}


class _ClassTarget(_Eliminate):
    def data(self, t: Table) -> tuple[DataFrame, int]:
        labels = classes(t)
        k = class_index(t, labels).cast("double")
        return t.df.select(vector(t).alias(VEC), k.alias(IDX)).where(F.col(IDX).isNotNull()), len(labels)


@register
class RfeForest(_ClassTarget):
    name = "rfe_random_forest"

    def strengths(self, t):
        data, _ = self.data(t)
        forest = RandomForestClassifier(featuresCol=VEC, labelCol=IDX, numTrees=10, maxDepth=self.params.get("depth", 10), seed=0)
        return forest.fit(data).featureImportances.toArray()


@register
class RfeBoosting(_ClassTarget):
    """20 boosted trees per class against the rest; importances add up."""

    name = "rfe_gradient_boosting"

    def strengths(self, t):
        data, k = self.data(t)
        total = np.zeros(len(t.features))
        for i in [1] if k == 2 else range(k):
            flags = data.withColumn(IDX, (F.col(IDX) == i).cast("double"))
            gbt = GBTClassifier(featuresCol=VEC, labelCol=IDX, maxIter=20, maxDepth=3, stepSize=0.1, seed=0)
            total += gbt.fit(flags).featureImportances.toArray()
        return total


@register
class RfeForestRegressor(_Eliminate):
    name = "rfe_random_forest_regressor"
    contract = "c_r"

    def strengths(self, t):
        data = t.df.select(vector(t).alias(VEC), t.number(t.label).alias(IDX))
        forest = RandomForestRegressor(featuresCol=VEC, labelCol=IDX, numTrees=10, maxDepth=self.params.get("depth", 10), seed=0)
        return forest.fit(data).featureImportances.toArray()


@register
class RfeLinearSvr(_Eliminate):
    """Linear regression with the epsilon-insensitive loss (epsilon 0.1, C 1).

    Reweighted least squares on the loss smoothed near its kinks: every step is
    one weighted moment pass. The absolute weights rank the features.
    """

    name = "rfe_linear_svr"
    contract = "c_r"

    def strengths(self, t):
        names = list(t.features)
        m = moments(Table(t.df, t.key, None, (*names, t.label)))
        p = len(names)
        # Start from ridge, the smooth neighbour of the same problem.
        w = np.linalg.solve(m.scatter[:p, :p] + np.eye(p), m.scatter[:p, p])
        bias = float(m.mean[p] - w @ m.mean[:p])
        eps, c_ = self.params.get("epsilon", 0.1), self.params.get("C", 1.0)
        x = [t.number(n) - F.lit(float(v)) for n, v in zip(names, m.mean[:p])]
        bias += float(w @ m.mean[:p])
        smooth = 1e-3 * float(np.sqrt(m.scatter[p, p] / m.n)) or 1e-6
        for _ in range(self.params.get("steps", 10)):
            fit = F.lit(bias)
            for xi, wi in zip(x, w):
                fit = fit + xi * F.lit(float(wi))
            gap = t.number(t.label) - fit
            over = F.greatest(F.abs(gap) - eps, F.lit(0.0))
            # Weight of the quadratic that touches the loss at the current gap.
            weight = F.when(over > 0, 1.0 / (F.abs(gap) + smooth)).otherwise(0.0)
            y = t.number(t.label) - F.when(gap > 0, eps).otherwise(-eps)
            cols = [*x, F.lit(1.0)]
            aggs = {(i, j): F.sum(weight * cols[i] * cols[j]) for i in range(p + 1) for j in range(i, p + 1)}
            aggs |= {(i, "y"): F.sum(weight * cols[i] * y) for i in range(p + 1)}
            row = one_row(t.df, aggs)
            a = np.array([[row[min(i, j), max(i, j)] or 0.0 for j in range(p + 1)] for i in range(p + 1)])
            b = np.array([row[i, "y"] or 0.0 for i in range(p + 1)])
            penalty = np.append(np.full(p, 1.0 / c_), 1e-9)
            found = np.linalg.solve(a + np.diag(penalty), b)
            moved = np.abs(found[:p] - w).max() / (np.abs(w).max() + 1e-12)
            w, bias = found[:p], float(found[p])
            if moved < 1e-4:
                break
        return np.abs(w)
