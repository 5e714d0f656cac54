"""Linear and quadratic discriminants, centroids, ridge: moments in, expressions out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tabloom.frame import Table
from tabloom.functions.linear import affine, first_max, first_min, softmax, squared_distances, whitening
from tabloom.functions.stats import Moments, class_index, class_stats, moments, one_row
from tabloom.operators.base import register
from tabloom.operators.learner import Classifier


@register
class LinearDiscriminant(Classifier):
    """Class means and one pooled covariance."""

    name = "clf_lda"
    title = "LinearDiscriminantAnalysisPrim"

    def learn(self, t):
        per = moments(t, by_class=True)
        labels = sorted(per)
        n = np.array([per[y].n for y in labels], dtype=float)
        mean = np.array([per[y].mean for y in labels])
        pooled = sum(per[y].scatter for y in labels) / n.sum()
        white = whitening(pooled)
        inverse = white.T @ white
        centre = (n @ mean) / n.sum()
        shifted = mean - centre
        weights = shifted @ inverse
        bias = np.log(n / n.sum()) - 0.5 * np.einsum("ij,ij->i", weights, shifted)
        return {"labels": labels, "weights": weights.tolist(), "bias": bias.tolist(), "centre": centre.tolist()}

    def apply(self, t, state):
        x = [t.number(n) - F.lit(float(m)) for n, m in zip(t.features, state["centre"])]
        return self.outputs(t, state["labels"], softmax(affine(x, np.array(state["weights"]), np.array(state["bias"]))))


@register
class QuadraticDiscriminant(Classifier):
    """One sample covariance per class."""

    name = "clf_qda"
    title = "QuadraticDiscriminantAnalysis"

    def learn(self, t):
        per = moments(t, by_class=True)
        labels = sorted(per)
        total = sum(per[y].n for y in labels)
        out = {"labels": labels, "mean": [], "whiten": [], "bias": []}
        for y in labels:
            m: Moments = per[y]
            white = whitening(m.scatter / max(m.n - 1, 1))
            out["mean"].append(m.mean.tolist())
            out["whiten"].append(white.tolist())
            log_det = -np.linalg.slogdet(white @ white.T)[1]
            out["bias"].append(float(np.log(m.n / total) - 0.5 * log_det))
        return out

    def apply(self, t, state):
        logs = []
        for mean, white, bias in zip(state["mean"], state["whiten"], state["bias"]):
            x = [t.number(n) - F.lit(float(m)) for n, m in zip(t.features, mean)]
            total = F.lit(0.0)
            for z in affine(x, np.array(white), np.zeros(len(white))):
                total = total + z * z
            logs.append(F.lit(bias) - 0.5 * total)
        return self.outputs(t, state["labels"], softmax(logs))


@register
class NearestCentroid(Classifier):
    name = "clf_nearest_centroid"
    title = "NearestCentroid"

    def learn(self, t):
        s = class_stats(t)
        return {"labels": s.labels, "centres": s.mean.tolist()}

    def apply(self, t, state):
        gaps = squared_distances([t.number(n) for n in t.features], np.array(state["centres"]))
        return self.one_hot_outputs(t, state["labels"], first_min(gaps, state["labels"]))


def _targets(t: Table, labels) -> Table:
    """One -1/+1 column per class (a single one for two classes)."""
    k = class_index(t, labels)
    ones = range(len(labels)) if len(labels) > 2 else [1]
    cols = {n: t.number(n) for n in t.features}
    return t.derive({**cols, **{f"__t{i}": F.when(k == i, 1.0).otherwise(-1.0) for i in ones}})


def _ridge_system(t: Table, labels):
    p = len(t.features)
    m = moments(_targets(t, labels))
    return m, m.scatter[:p, :p], m.scatter[:p, p:], m.mean[:p], m.mean[p:]


@register
class RidgeClassifier(Classifier):
    """Least squares on -1/+1 targets from one moment pass; penalty 1, centred."""

    name = "clf_ridge"
    title = "RidgeClassifier"

    def learn(self, t):
        labels = class_stats(t, []).labels
        _, gram, cross, mean, target = _ridge_system(t, labels)
        return self.solve(labels, gram, cross, mean, target, self.params.get("alpha", 1.0))

    @staticmethod
    def solve(labels, gram, cross, mean, target, alpha) -> dict:
        w = np.linalg.solve(gram + alpha * np.eye(len(gram)), cross).T
        return {
            "labels": labels,
            "weights": w.tolist(),
            "target": target.tolist(),
            "mean": mean.tolist(),
            "alpha": alpha,
        }

    def apply(self, t, state):
        labels = state["labels"]
        x = [t.number(n) - F.lit(float(m)) for n, m in zip(t.features, state["mean"])]
        scores = affine(x, np.array(state["weights"]), np.array(state["target"]))
        if len(labels) == 2:
            chosen = F.when(scores[0] > 0, F.lit(labels[1])).otherwise(F.lit(labels[0]))
        else:
            chosen = first_max(scores, labels)
        return self.one_hot_outputs(t, labels, chosen)


@register
class RidgeClassifierCV(RidgeClassifier):
    """Penalty from {0.1, 1, 10} by leave-one-out error.

    The left-out residual of a row is its residual / (1 - leverage), and both
    are expressions, so all penalties are scored in a single second pass.
    """

    name = "clf_ridge_cv"
    title = "RidgeClassifierCV"
    alphas = (0.1, 1.0, 10.0)

    def learn(self, t):
        labels = class_stats(t, []).labels
        m, gram, cross, mean, target = _ridge_system(t, labels)
        wide = _targets(t, labels)
        p = len(t.features)
        x = [c_ - F.lit(float(v)) for c_, v in zip([wide.number(n) for n in t.features], mean)]
        values, vectors = np.linalg.eigh(gram)
        rotated = affine(x, vectors.T, np.zeros(p))
        errors = {}
        fits = {a: self.solve(labels, gram, cross, mean, target, a) for a in self.alphas}
        for a, fit in fits.items():
            leverage = F.lit(1.0 / m.n)
            for r, v in zip(rotated, values):
                leverage = leverage + r * r * F.lit(float(1 / (v + a)))
            total = F.lit(0.0)
            for j, s in enumerate(affine(x, np.array(fit["weights"]), np.array(fit["target"]))):
                gap = (wide.number(wide.features[p + j]) - s) / (1 - leverage)
                total = total + gap * gap
            errors[a] = F.sum(total)
        row = one_row(wide.df, errors)
        return fits[min(self.alphas, key=lambda a: row[a])]
