"""Scalers, transforms to a given shape, and quantile bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tabloom.frame import Table
from tabloom.functions.rank import literal_array, quantiles, range_of
from tabloom.functions.stats import one_row, unpivot
from tabloom.operators.base import Operator, register


class _Scale(Operator):
    family = "feature preprocess"
    contract = "c_t"
    suffix = "_scaled"
    # Already binary one-hot columns keep their name in the range scalers.
    skip_one_hot_name = False

    def rename(self, n: str) -> str:
        return n if self.skip_one_hot_name and "one_hot" in n else n + self.suffix


class _ShiftScale(_Scale):
    """(x - shift) / width with one literal pair per column; width 0 counts as 1."""

    def columns(self, t, state):
        return {
            self.rename(n): (t.number(n) - F.lit(shift)) / F.lit(width or 1.0)
            for n, (shift, width) in state["scale"].items()
        }


@register
class MinMaxScale(_ShiftScale):
    name = "minmax_scale"
    suffix = "_mnmxscale"
    skip_one_hot_name = True

    def learn(self, t):
        row = one_row(t.df, {f"{f}:{n}": g(t.number(n)) for n in t.features for f, g in (("a", F.min), ("b", F.max))})
        return {"scale": {n: (row[f"a:{n}"], row[f"b:{n}"] - row[f"a:{n}"]) for n in t.features}}


@register
class MaxAbsScale(_ShiftScale):
    name = "maxabs_scale"
    suffix = "_mxabsscale"
    skip_one_hot_name = True

    def learn(self, t):
        row = one_row(t.df, {n: F.max(F.abs(t.number(n))) for n in t.features})
        return {"scale": {n: (0.0, row[n]) for n in t.features}}


@register
class RobustScale(_ShiftScale):
    name = "robust_scale"
    suffix = "_rbstscale"

    def learn(self, t):
        q = quantiles(t.df, {n: t.number(n) for n in t.features}, [0.25, 0.5, 0.75])
        return {"scale": {n: (v[1], v[2] - v[0]) for n, v in q.items()}}


@register
class StandardScale(_ShiftScale):
    """Population standard deviation, centred."""

    name = "standard_scale"
    suffix = "_stndrdscale"

    def learn(self, t):
        row = one_row(
            t.df, {f"{f}:{n}": g(t.number(n)) for n in t.features for f, g in (("m", F.avg), ("s", F.stddev_pop))}
        )
        return {"scale": {n: (row[f"m:{n}"], row[f"s:{n}"]) for n in t.features}}


@register
class NormalizeRows(_Scale):
    name = "normalize_rows"
    suffix = "_nrmlzr"

    def columns(self, t, state):
        total: Column = F.lit(0.0)
        for n in t.features:
            total = total + t.number(n) * t.number(n)
        norm = F.when(total == 0, 1.0).otherwise(F.sqrt(total))
        return {self.rename(n): t.number(n) / norm for n in t.features}


@register
class QuantileTransform(_Scale):
    """Empirical CDF through up to 1000 exact landmarks.

    Where landmarks repeat (ties) the mean of the first and the last position
    is taken, which for a value between distinct landmarks is plain linear
    interpolation. The fit holds 1000 numbers per column.
    """

    name = "quantile_transform"
    suffix = "_qntl"

    def learn(self, t):
        rows = t.df.count()
        k = max(1, min(self.params.get("landmarks", 1000), rows))
        probs = [i / (k - 1) for i in range(k)] if k > 1 else [0.0]
        return {"probs": probs, "landmarks": quantiles(t.df, {n: t.number(n) for n in t.features}, probs)}

    def columns(self, t, state):
        out = {}
        for n, marks in state["landmarks"].items():
            first, last = {}, {}
            for p, x in zip(state["probs"], marks):
                first.setdefault(x, p)
                last[x] = p
            xs = sorted(first)
            place = _by_expression if len(xs) <= EXPRESSION_MARKS else _by_batch
            out[self.rename(n)] = place(t.number(n), xs, [first[x] for x in xs], [last[x] for x in xs])
        return out


# Up to this many landmarks the map is a literal search in generated code;
# beyond it a binary search over Arrow batches is several times faster.
EXPRESSION_MARKS = 16


def _by_expression(v: Column, xs: list, first: list, last: list) -> Column:
    """Between landmarks: from the last position of x0 to the first of x1; on a landmark: their mean."""
    inside = F.when(v.isNotNull(), F.lit(0.0))
    if len(xs) > 1:
        i = F.least(F.greatest(range_of(v, xs) - 1, F.lit(0)), F.lit(len(xs) - 2)).cast("int")
        xa, fa, la = (literal_array([float(z) for z in zs]) for zs in (xs, first, last))
        x0, x1 = F.get(xa, i), F.get(xa, i + 1)
        slope = (F.get(fa, i + 1) - F.get(la, i)) / (x1 - x0)
        inside = F.when(v == x0, (F.get(fa, i) + F.get(la, i)) / 2.0).otherwise(F.get(la, i) + slope * (v - x0))
    return F.when(v <= F.lit(xs[0]), 0.0).when(v >= F.lit(xs[-1]), 1.0).otherwise(inside)


def _by_batch(v: Column, xs: list, first: list, last: list) -> Column:
    x, fa, la = (np.array(z, dtype=float) for z in (xs, first, last))

    @F.pandas_udf(T.DoubleType())
    def place(values: pd.Series) -> pd.Series:
        q = values.to_numpy(dtype=float)
        i = np.clip(np.searchsorted(x, q, side="right") - 1, 0, len(x) - 2)
        x0, x1 = x[i], x[i + 1]
        y = np.where(q == x0, (fa[i] + la[i]) / 2, la[i] + (fa[i + 1] - la[i]) * (q - x0) / (x1 - x0))
        y = np.where(q <= x[0], 0.0, np.where(q >= x[-1], 1.0, y))
        return pd.Series(y).where(~np.isnan(q))

    return place(v)


def yeo_johnson(x: Column, lam: float | Column) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    two = 2.0 - lam
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    neg = F.when(F.abs(two) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, two) - 1.0) / two)
    return F.when(x >= 0, pos).otherwise(neg)


@register
class PowerTransform(_Scale):
    """Yeo-Johnson with the most likely exponent, then standardised.

    The profile likelihood needs only the variance of the transformed column.
    One pass scores a coarse grid of exponents for all columns; the following
    passes fit a parabola through three exponents around the best one, with a
    shrinking step.
    """

    name = "power_transform"
    suffix = "_pwrtrnsfrm"
    # Coarse grid of exponents; the step of the refining passes shrinks from its spacing.
    grid = (-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0)

    def _likelihoods(self, t: Table, tries: dict[str, list[float]], logs: dict[str, float]) -> dict:
        lists = F.create_map(*[v for n in t.features for v in (F.lit(n), literal_array(tries[n]))])
        long = unpivot(t.df, {n: t.number(n) for n in t.features})
        scored = (
            long.select("feature", "value", F.posexplode(lists[F.col("feature")]).alias("i", "lam"))
            .groupBy("feature", "i")
            .agg(F.var_pop(yeo_johnson(F.col("value"), F.col("lam"))).alias("var"), F.count("value").alias("n"))
        )
        out = {}
        for r in scored.collect():  # one row per column and exponent
            lam = tries[r["feature"]][r["i"]]
            fits = r["var"] is not None and 0 < r["var"] < math.inf
            shift = (lam - 1) * (logs[r["feature"]] or 0.0)
            out[r["feature"], r["i"]] = shift - r["n"] / 2 * math.log(r["var"]) if fits else -math.inf
        return out

    def _best(self, t: Table) -> dict[str, float]:
        logs = one_row(t.df, {n: F.sum(F.signum(t.number(n)) * F.log1p(F.abs(t.number(n)))) for n in t.features})
        found = self._likelihoods(t, {n: list(self.grid) for n in t.features}, logs)
        at = {n: max(self.grid, key=lambda v: found.get((n, self.grid.index(v)), -math.inf)) for n in t.features}
        step = 0.5
        for _ in range(self.params.get("passes", 4)):
            found = self._likelihoods(t, {n: [v - step, v, v + step] for n, v in at.items()}, logs)
            for n in t.features:
                low, mid, high = (found.get((n, i), -math.inf) for i in range(3))
                bend = low - 2 * mid + high
                if math.isfinite(bend) and bend < 0:
                    at[n] += max(-2.0, min(2.0, (low - high) / (2 * bend))) * step
            step /= 4
        return at

    def learn(self, t):
        fixed = self.params.get("exponents")
        lam = dict(zip(t.features, fixed)) if fixed else self._best(t)
        aggs = {}
        for n in t.features:
            aggs[("m", n)] = F.avg(yeo_johnson(t.number(n), lam[n]))
            aggs[("s", n)] = F.stddev_pop(yeo_johnson(t.number(n), lam[n]))
        row = one_row(t.df, aggs)
        return {"power": {n: (lam[n], row[("m", n)], row[("s", n)]) for n in t.features}}

    def columns(self, t, state):
        return {
            self.rename(n): (yeo_johnson(t.number(n), lam) - F.lit(m)) / F.lit(s or 1.0)
            for n, (lam, m, s) in state["power"].items()
        }


def bin_edges(t: Table, names: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Interior quantile edges, repeated ones dropped."""
    q = quantiles(t.df, {n: t.number(n) for n in names}, [i / bins for i in range(bins + 1)])
    out = {}
    for n, v in q.items():
        v = v or []
        distinct = sorted(set(v))
        out[n] = distinct[1:-1]
    return out


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Right-open bins; the last one is closed."""
    return F.when(value.isNotNull(), range_of(value, list(edges)))


@register
class KBinsOrdinal(_Scale):
    name = "kbins_ordinal"
    contract = "c_t_kbins"
    suffix = "_ordnldscrtzr"

    def learn(self, t):
        return {"edges": bin_edges(t, t.features, self.params.get("bins", 5))}

    def columns(self, t, state):
        return {self.rename(n): bin_of(t.number(n), e).cast("double") for n, e in state["edges"].items()}


@register
class KBinsOneHot(_Scale):
    name = "kbins_one_hot"
    contract = "kbinsohe"
    suffix = "_onhtbnrzr"

    def learn(self, t):
        return {"edges": bin_edges(t, t.features, self.params.get("bins", 5))}

    def apply(self, t, state):
        # The bin of a value is found once; its flags only compare.
        found = F.array(*[bin_of(t.number(n), e).cast("int") for n, e in state["edges"].items()])
        binned = t.with_df(t.df.withColumn("__bins", found))
        out = {}
        for i, (n, edges) in enumerate(state["edges"].items()):
            for j in range(len(edges) + 1):
                out[f"{self.rename(n)}{j}"] = F.when(F.get("__bins", F.lit(i)) == j, 1.0).otherwise(0.0)
        return binned.derive(out)
