"""Naive Bayes family: one grouped pass, then a linear or quadratic log score."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tabloom.frame import Table, c
from tabloom.functions.linear import affine, softmax
from tabloom.functions.stats import MAX_CLASSES, TooManyLevels, class_stats, one_row
from tabloom.operators.base import register
from tabloom.operators.learner import Classifier


def _class_sums(t: Table, value) -> tuple[list, np.ndarray, np.ndarray]:
    aggs = [F.sum(value(n)).alias(f"s{i}") for i, n in enumerate(t.features)]
    rows = (
        t.df.where(c(t.label).isNotNull())
        .groupBy(c(t.label).alias("y"))
        .agg(F.count("*").alias("n"), *aggs)
        .limit(MAX_CLASSES + 1)
        .collect()
    )
    if len(rows) > MAX_CLASSES:
        raise TooManyLevels(f"more than {MAX_CLASSES} classes in {t.label}")
    rows = sorted(rows, key=lambda r: r["y"])
    sums = np.array([[r[f"s{i}"] for i in range(len(t.features))] for r in rows], dtype=float)
    return [r["y"] for r in rows], np.array([r["n"] for r in rows], dtype=float), sums


class _LinearBayes(Classifier):
    """Log scores that are affine in the (possibly binarised) features."""

    def value(self, t: Table, n: str):
        return t.number(n)

    def apply(self, t, state):
        logs = affine([self.value(t, n) for n in t.features], np.array(state["weights"]), np.array(state["bias"]))
        return self.outputs(t, state["labels"], softmax(logs))


@register
class MultinomialNB(_LinearBayes):
    name = "clf_multinomial_nb"
    title = "MultinomialNB"
    contract = "d"

    def learn(self, t):
        labels, n, sums = _class_sums(t, t.number)
        share = (sums + 1) / (sums + 1).sum(axis=1, keepdims=True)
        return {"labels": labels, "weights": np.log(share).tolist(), "bias": np.log(n / n.sum()).tolist()}


@register
class ComplementNB(_LinearBayes):
    """Weights from the sums of all other classes; no prior with several classes."""

    name = "clf_complement_nb"
    title = "ComplementNBClassifier"
    contract = "d"

    def learn(self, t):
        labels, n, sums = _class_sums(t, t.number)
        rest = sums.sum(axis=0) + 1 - sums
        weights = -np.log(rest / rest.sum(axis=1, keepdims=True))
        bias = np.log(n / n.sum()) if len(labels) == 1 else np.zeros(len(labels))
        return {"labels": labels, "weights": weights.tolist(), "bias": bias.tolist()}


@register
class BernoulliNB(_LinearBayes):
    """Features binarised at zero, add-one smoothing."""

    name = "clf_bernoulli_nb"
    title = "BernoulliNBClassifier"

    def value(self, t, n):
        return (t.number(n) > 0).cast("double")

    def learn(self, t):
        labels, n, hits = _class_sums(t, lambda name: self.value(t, name))
        p = (hits + 1) / (n[:, None] + 2)
        bias = np.log(n / n.sum()) + np.log(1 - p).sum(axis=1)
        return {"labels": labels, "weights": (np.log(p) - np.log(1 - p)).tolist(), "bias": bias.tolist()}


@register
class GaussianNB(Classifier):
    """Per-class means and population variances, smoothed by 1e-9 of the largest variance."""

    name = "clf_gaussian_nb"
    title = "GaussianNBClassifier"

    def learn(self, t):
        s = class_stats(t)
        whole = one_row(t.df, {n: F.var_pop(t.number(n)) for n in t.features})
        var = s.var + 1e-9 * max(whole.values())
        return {
            "labels": s.labels,
            "prior": (s.n / s.n.sum()).tolist(),
            "mean": s.mean.tolist(),
            "var": var.tolist(),
        }

    def apply(self, t, state):
        x = [t.number(n) for n in t.features]
        mean, var = np.array(state["mean"]), np.array(state["var"])
        # -(x - m)^2 / 2v expands to an affine map of (x^2, x), but not stably;
        # the shared centre keeps the products small.
        centre = mean.mean(axis=0)
        z = [xi - F.lit(float(m)) for xi, m in zip(x, centre)]
        shifted = mean - centre
        weights = np.hstack([-0.5 / var, shifted / var])
        bias = (
            np.log(state["prior"])
            - 0.5 * np.log(2 * math.pi * var).sum(axis=1)
            - 0.5 * (shifted**2 / var).sum(axis=1)
        )
        logs = affine([v * v for v in z] + z, weights, bias)
        return self.outputs(t, state["labels"], softmax(logs))
