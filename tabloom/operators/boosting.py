"""Boosted stumps: every round is one aggregate over pre-binned rows.

Rows carry their bins, class and one weight per ensemble member. A round sums
the weights per (feature, bin, class) for all members at once; the best cut per
member is chosen on the driver from that small table, and the weights are
updated by an expression. The lineage is cut at the shared checkpoint folder
every ``CUT_EVERY`` rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table, c
from tabloom.functions.keys import MODULUS, keyed_hash
from tabloom.functions.linear import softmax
from tabloom.functions.rank import literal_array, quantiles, range_of
from tabloom.functions.stats import class_index, class_stats, classes
from tabloom.operators.base import register
from tabloom.operators.bootstrap import balanced_bootstrap
from tabloom.operators.grow import LOCAL_ROWS, Grower, Rule, with_shares
from tabloom.operators.learner import Classifier, roles_of
from tabloom.operators.scale import bin_of
from tabloom.operators.trees import DEEP
from tabloom.session import cut_lineage

CUT_EVERY = 10
MAX_BINS = 32
EPS = float(np.finfo(float).eps)


class _StumpEnsemble(Classifier):
    """Members of SAMME.R boosting (Zhu et al. 2009) that grow side by side."""

    rounds, members = 50, 1
    resample_members = False  # one balanced sample per member
    resample_rounds = False  # a new balanced sample every round

    def learn(self, t):
        s = class_stats(t, [])
        labels, k, m = s.labels, len(s.labels), self.params.get("members", self.members)
        edges = stump_edges(t)
        rate = s.n.min() / s.n
        # The compact bins are written once; no round reads the source again.
        rows = cut_lineage(self._rows(t, labels, edges, rate, m))
        stumps: list[list[dict]] = [[] for _ in range(m)]
        open_members = set(range(m))
        for step in range(self.params.get("rounds", self.rounds)):
            table = self._histogram(rows, len(t.features), k, m, rate, step)
            updates: list = [None] * m
            for j in sorted(open_members):
                stump = best_stump(table[j], [edges[n] for n in t.features])
                if stump is None:
                    open_members.discard(j)
                    continue
                stumps[j].append(stump)
                if stump["error"] <= 0:
                    open_members.discard(j)
                    continue
                updates[j] = weight_factors(stump, k)
            if not open_members:
                break
            rows = rows.withColumn("w", F.array(*[self._updated(j, u) for j, u in enumerate(updates)]))
            if (step + 1) % CUT_EVERY == 0:
                rows = cut_lineage(rows)
        return {"labels": labels, "stumps": stumps}

    def _rows(self, t: Table, labels, edges, rate, m) -> DataFrame:
        seed = self.params.get("seed", 0)
        bins = F.array(*[bin_of(t.number(n), edges[n]).cast("int") for n in t.features])
        df = t.df.select(
            bins.alias("b"),
            class_index(t, labels).alias("k"),
            *[keyed_hash(t.df, t.key, seed + 1 + j).alias(f"h{j}") for j in range(m if self.resample_members else 1)],
        ).where(F.col("k").isNotNull())
        ones = [self._kept(f"h{j}", rate, 0) if self.resample_members else F.lit(1.0) for j in range(m)]
        kept = [F.col("b"), F.col("k"), F.col("h0").alias("h"), F.array(*ones).alias("w")]
        return df.select(*kept)

    @staticmethod
    def _kept(h: str, rate: np.ndarray, step: int) -> Column:
        """1 for a row in the balanced sample: each class keeps the share min size / size."""
        draw = F.pmod(F.col(h) * 48271 + step * 1103515245, F.lit(MODULUS)) / MODULUS
        share = F.get(F.array(*[F.lit(float(r)) for r in rate]), F.col("k"))
        return (draw < share).cast("double")

    def _histogram(self, rows: DataFrame, p: int, k: int, m: int, rate, step: int) -> np.ndarray:
        weights = [F.get("w", F.lit(j)) for j in range(m)]
        if self.resample_rounds:
            weights = [w * self._kept("h", rate, step + 1) for w in weights]
        long = rows.select("k", *[w.alias(f"w{j}") for j, w in enumerate(weights)], F.posexplode("b").alias("f", "b"))
        sums = long.groupBy("f", "b", "k").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(m)])
        table = np.zeros((m, p, MAX_BINS, k))
        for r in sums.collect():  # features * bins * classes rows
            for j in range(m):
                table[j, r["f"], r["b"], r["k"]] = r[f"w{j}"]
        return table

    @staticmethod
    def _updated(j: int, update) -> Column:
        w = F.get("w", F.lit(j))
        if update is None:
            return w
        f, cut, left, right = update
        sides = [F.get(F.array(*[F.lit(float(v)) for v in side]), F.col("k")) for side in (left, right)]
        return w * F.when(F.get("b", F.lit(f)) <= cut, sides[0]).otherwise(sides[1])

    def apply(self, t, state):
        labels = state["labels"]
        k = len(labels)
        shares = []
        for stumps in state["stumps"]:
            totals: list[Column] = [F.lit(0.0)] * k
            for f, (cuts, steps) in step_functions(stumps, k).items():
                at = range_of(t.number(t.features[f]), cuts)
                for i in range(k):
                    totals[i] = totals[i] + F.get(literal_array(steps[:, i].tolist()), at)
            n = max(len(stumps), 1) * max(k - 1, 1)
            shares.append(softmax([v / n for v in totals]))
        mean = []
        for i in range(k):
            total = shares[0][i]
            for s in shares[1:]:
                total = total + s[i]
            mean.append(total / len(shares))
        return self.outputs(t, labels, mean)


def stump_edges(t: Table) -> dict[str, list[float]]:
    """Up to 31 cut points per feature; the smallest value never cuts."""
    probs = [i / (MAX_BINS - 1) for i in range(MAX_BINS)]
    found = quantiles(t.df, {n: t.number(n) for n in t.features}, probs)
    return {n: sorted(set(v or []))[1:] for n, v in found.items()}


def step_functions(stumps: list[dict], k: int) -> dict[int, tuple[list[float], np.ndarray]]:
    """All stumps on one feature add up to a step function: cuts and value per step and class."""
    out = {}
    for f in sorted({s["feature"] for s in stumps}):
        mine = [s for s in stumps if s["feature"] == f]
        cuts = sorted({s["cut"] for s in mine})
        steps = np.zeros((len(cuts) + 1, k))
        for s in mine:
            logs = [np.log(np.clip(np.array(s[side]), EPS, None)) for side in ("left", "right")]
            votes = [(k - 1) * (v - v.mean()) for v in logs]
            place = cuts.index(s["cut"]) + 1
            steps[:place] += votes[0]
            steps[place:] += votes[1]
        out[f] = (cuts, steps)
    return out


def best_stump(table: np.ndarray, edges: list[list[float]]) -> dict | None:
    """Cut with the least weighted Gini impurity; ``table`` is (feature, bin, class)."""
    total = table[0].sum(axis=0)
    mass = total.sum()
    if mass <= 0:
        return None
    best = None
    for f, cuts in enumerate(edges):
        left = np.cumsum(table[f], axis=0)
        for b in range(len(cuts)):
            lo, hi = left[b], total - left[b]
            nl, nr = lo.sum(), hi.sum()
            if nl <= mass * 1e-12 or nr <= mass * 1e-12:
                continue
            impurity = mass - (lo @ lo) / nl - (hi @ hi) / nr
            if best is None or impurity < best[0] - 1e-15 * mass:
                best = (impurity, f, b, lo, hi)
    if best is None:
        return None
    _, f, b, lo, hi = best
    lo, hi = np.clip(lo, 0, None), np.clip(hi, 0, None)
    return {
        "feature": f,
        "bin": b,
        "cut": float(edges[f][b]),
        "left": (lo / lo.sum()).tolist(),
        "right": (hi / hi.sum()).tolist(),
        "mass": [lo.tolist(), hi.tolist()],
        "error": float(1 - (lo.max() + hi.max()) / mass),
    }


def weight_factors(stump: dict, k: int):
    """Per side and class: the SAMME.R factor, scaled so that the weights sum to one."""
    code = np.full((k, k), -1.0 / (k - 1) if k > 1 else 0.0)
    np.fill_diagonal(code, 1.0)
    factors = []
    for side in ("left", "right"):
        logs = np.log(np.clip(np.array(stump[side]), EPS, None))
        factors.append(np.exp(-(k - 1) / k * (code @ logs)))
    total = sum(float(np.dot(f, m)) for f, m in zip(factors, stump["mass"]))
    left, right = (f / total for f in factors)
    return stump["feature"], stump["bin"], left, right


@register
class AdaBoost(_StumpEnsemble):
    name = "clf_adaboost"
    title = "AdaBoostClassifier"


@register
class EasyEnsemble(_StumpEnsemble):
    """10 boosted members, each on its own balanced sample; all members share every pass."""

    name = "clf_easy_ensemble"
    title = "EasyEnsembleClassifier"
    members = 10
    resample_members = True


@register
class RusBoost(_StumpEnsemble):
    """A new balanced sample in every round."""

    name = "clf_rusboost"
    title = "RUSBoostClassifier"
    resample_rounds = True


@register
class BalancedForest(Classifier):
    """100 trees, each on a bootstrap with as many rows of every class as the smallest class has.

    Square-root feature subsets, best cuts. ``depth`` bounds the trees as in the other
    forests; the state is plain JSON, which names a folder if the forest is large.
    """

    name = "clf_balanced_random_forest"
    title = "BalancedRandomForestClassifier"

    def learn(self, t):
        labels, p = classes(t), len(t.features)
        seed, trees = self.params.get("seed", 0), self.params.get("trees", 100)
        rule = Rule(len(labels), p, max(1, int(p**0.5)), seed, False, self.params.get("depth", DEEP))
        rows = cut_lineage(balanced_bootstrap(t, labels, trees, seed).select("x", "y", "w"))
        return {"labels": labels} | Grower(rows, trees, rule, self.params.get("local_rows", LOCAL_ROWS)).state()

    def apply(self, t, state):
        scored = t.with_df(with_shares(t.df, state, [t.number(n) for n in t.features], [c(n) for n in roles_of(t)]))
        return self.outputs(scored, state["labels"], [F.get("__prob", F.lit(i)) for i in range(len(state["labels"]))])
