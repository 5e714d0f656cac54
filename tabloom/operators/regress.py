"""Regressors."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tabloom.functions.linear import affine
from tabloom.functions.stats import moments, one_row
from tabloom.operators.base import register
from tabloom.operators.learner import Regressor
from tabloom.operators.trees import IDX, VEC, vector
from tabloom.session import cut_lineage


@register
class ArdRegression(Regressor):
    """Bayesian linear model with one precision per weight (MacKay 1994).

    One pass gives the centred moments of features and target; the fixed point
    over precisions works on p x p numbers.
    """

    name = "reg_ard"
    title = "ARDRegression"

    def learn(self, t):
        names = list(t.features)
        wide = replace(t, df=t.df.withColumn("__y", t.number(t.label)), features=(*names, "__y"))
        m = moments(wide)
        p = len(names)
        gram, cross, yy = m.scatter[:p, :p], m.scatter[:p, p], m.scatter[p, p]
        prior = dict(a1=1e-6, a2=1e-6, l1=1e-6, l2=1e-6)  # Gamma priors, all 1e-6
        alpha = 1.0 / (yy / m.n + float(np.finfo(float).eps))
        lam = np.ones(p)
        w = np.zeros(p)
        for _ in range(self.params.get("max_iter", 300)):
            keep = lam < 1e4
            sigma = np.linalg.pinv(alpha * gram[np.ix_(keep, keep)] + np.diag(lam[keep]), hermitian=True)
            new = np.zeros(p)
            new[keep] = alpha * sigma @ cross[keep]
            rss = max(yy - 2 * new @ cross + new @ gram @ new, 0.0)
            gamma = 1 - lam[keep] * np.diag(sigma)
            lam[keep] = (gamma + 2 * prior["l1"]) / (new[keep] ** 2 + 2 * prior["l2"])
            alpha = (m.n - gamma.sum() + 2 * prior["a1"]) / (rss + 2 * prior["a2"])
            lam_cut = lam >= 1e4
            new[lam_cut] = 0.0
            moved = np.abs(new - w).sum()
            w = new
            if moved < 1e-3:
                break
        mean = m.mean[:p]
        return {"weights": w.tolist(), "bias": float(m.mean[p] - w @ mean), "alpha": float(alpha)}

    def apply(self, t, state):
        x = [t.number(n) for n in t.features]
        return self.outputs(t, affine(x, np.array(state["weights"]), np.array([state["bias"]]))[0])


@register
class AdaBoostRegressor(Regressor):
    """AdaBoost.R2 (Drucker 1997), trees of depth 3, linear loss, weighted median.

    Row weights replace the weighted resampling: same expectation, no draw.
    """

    name = "reg_adaboost"
    title = "AdaBoostRegressor"

    def learn(self, t):
        rows = cut_lineage(t.df.select(vector(t).alias(VEC), t.number(t.label).alias(IDX), F.lit(1.0).alias("w")))
        models, votes = [], []
        for i in range(self.params.get("rounds", 50)):
            tree = DecisionTreeRegressor(
                featuresCol=VEC, labelCol=IDX, weightCol="w", predictionCol="__f", maxDepth=3, seed=self.params.get("seed", 0) + i
            )
            model = tree.fit(rows)
            scored = model.transform(rows).withColumn("__e", F.abs(F.col("__f") - F.col(IDX)))
            s = one_row(scored, {"top": F.max("__e"), "we": F.sum(F.col("w") * F.col("__e")), "w": F.sum("w")})
            models.append(model)
            if not s["top"]:
                votes.append(1.0)
                break
            error = s["we"] / s["top"] / s["w"]
            if error >= 0.5:
                if len(models) > 1:
                    models.pop()
                else:
                    votes.append(1.0)
                break
            beta = error / (1 - error)
            votes.append(float(-np.log(beta)))
            factor = F.pow(F.lit(beta), 1 - F.col("__e") / s["top"]) * (1 / s["w"])
            rows = scored.select(VEC, IDX, (F.col("w") * factor).alias("w"))
            if (i + 1) % 5 == 0:
                rows = cut_lineage(rows)
        return {"models": models, "votes": votes}

    def apply(self, t, state):
        df = t.df.withColumn(VEC, vector(t))
        for i, model in enumerate(state["models"]):
            df = model.setPredictionCol(f"__f{i}").transform(df)
        pairs = F.array_sort(
            F.array(*[F.struct(F.col(f"__f{i}").alias("f"), F.lit(v).alias("v")) for i, v in enumerate(state["votes"])])
        )
        half = F.lit(sum(state["votes"]) / 2)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

        def step(acc, pair):
            total = acc["sum"] + pair["v"]
            at = F.when(acc["at"].isNull() & (total >= half), pair["f"]).otherwise(acc["at"])
            return F.struct(total.alias("sum"), at.alias("at"))

        return self.outputs(replace(t, df=df.withColumn("__m", pairs)), F.aggregate("__m", start, step, lambda a: a["at"]))
