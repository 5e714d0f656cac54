"""Feature selection on score tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabloom.frame import c
from tabloom.functions.stats import one_row
from tabloom.operators.base import Operator, register
from tabloom.operators.scores import SCORES


class Selector(Operator):
    family = "feature selection"
    contract = "c"
    need = "three_columns"

    def columns(self, t, state):
        return {n: c(n) for n in state["keep"]}


@register
class VarianceThreshold(Selector):
    """Columns that vary: exact min < max, which is population variance > 0."""

    name = "variance_threshold"
    contract = "c_t"

    def learn(self, t):
        row = one_row(t.df, {f"{f}:{n}": g(t.number(n)) for n in t.features for f, g in (("a", F.min), ("b", F.max))})
        keep = [n for n in t.features if row[f"a:{n}"] is not None and row[f"a:{n}"] < row[f"b:{n}"]]
        return {"keep": keep}


class _Scored(Selector):
    score = ""

    def choose(self, scored: list) -> list[str]:
        raise NotImplementedError

    def learn(self, t):
        position = {n: i for i, n in enumerate(t.features)}
        options = {k: v for k, v in self.params.items() if k in ("bins", "estimator", "neighbours")}
        rows = sorted(SCORES[self.score](t, **options).collect(), key=lambda r: position[r["feature"]])
        keep = set(self.choose(rows))
        # An empty choice passes the input through and says so.
        kept = [n for n in t.features if n in keep] or list(t.features)
        return {"keep": kept, "empty": not keep, "scores": {r["feature"]: r["score"] for r in rows}}


class _KBest(_Scored):
    def choose(self, scored):
        k = self.params.get("k", 10)
        ranked = sorted(scored, key=lambda r: -(r["score"] if r["score"] is not None else -math.inf))
        return [r["feature"] for r in ranked[: min(k, len(ranked))]]


class _Percentile(_Scored):
    def choose(self, scored):
        share = self.params.get("percentile", 10)
        values = sorted(r["score"] if r["score"] is not None else -math.inf for r in scored)
        h = (len(values) - 1) * (100 - share) / 100
        low, high = values[math.floor(h)], values[math.ceil(h)]
        cut = low if low == high else low + (high - low) * (h - math.floor(h))
        keep = [r["feature"] for r in scored if r["score"] is not None and r["score"] > cut]
        ties = [r["feature"] for r in scored if r["score"] == cut]
        return keep + ties[: max(0, int(len(scored) * share / 100) - len(keep))]


class _FalsePositiveRate(_Scored):
    def choose(self, scored):
        alpha = self.params.get("alpha", 0.05)
        return [r["feature"] for r in scored if r["p_value"] is not None and r["p_value"] < alpha]


class _FamilyWise(_Scored):
    def choose(self, scored):
        alpha = self.params.get("alpha", 0.05) / len(scored)
        return [r["feature"] for r in scored if r["p_value"] is not None and r["p_value"] < alpha]


class _FalseDiscoveryRate(_Scored):
    """Benjamini-Hochberg: everything up to the largest p under its rank's line."""

    def choose(self, scored):
        alpha = self.params.get("alpha", 0.05)
        known = sorted((r["p_value"], r["feature"]) for r in scored if r["p_value"] is not None)
        m = len(scored)
        below = [p for i, (p, _) in enumerate(known, 1) if p <= alpha * i / m]
        return [f for p, f in known if below and p <= below[-1]]


_RULES = {
    "kbest": _KBest,
    "percentile": _Percentile,
    "fpr": _FalsePositiveRate,
    "fdr": _FalseDiscoveryRate,
    "fwe": _FamilyWise,
}
_CONTRACTS = {"chi2": "d", "f_classif": "c", "mi_classif": "c", "f_regression": "c_r", "mi_regression": "c_r"}

# Every score goes with the two counting rules; the p-value rules need a score that has one.
for _score, _contract in _CONTRACTS.items():
    for _rule, _base in _RULES.items():
        if _score.startswith("mi_") and _rule not in ("kbest", "percentile"):
            continue
        register(
            type(
                f"Select_{_score}_{_rule}",
                (_base,),
                {"name": f"select_{_score}_{_rule}", "score": _score, "contract": _contract, "__doc__": _base.__doc__},
            )
        )

