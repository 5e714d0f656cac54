"""Principal components, SVD, independent components, random tree leaves.

Fits reduce the rows to p x p moments; the small eigenproblem is solved on the
driver and the projection is a set of column expressions.
"""

from __future__ import annotations

import random
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.frame import Table
from tabloom.functions.linear import affine, whitening
from tabloom.functions.stats import Moments, moments, number_columns, number_matrix
from tabloom.operators.base import Operator, register
from tabloom.session import cut_lineage


def principal_axes(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Variances (descending) and unit axes as rows; the largest loading is positive."""
    values, vectors = np.linalg.eigh(m.scatter)
    order = np.argsort(values)[::-1]
    axes = vectors[:, order].T
    return np.clip(values[order], 0, None) / max(m.n - 1, 1), fix_signs(axes)


def fix_signs(axes: np.ndarray) -> np.ndarray:
    top = np.abs(axes).argmax(axis=1)
    signs = np.sign(axes[np.arange(len(axes)), top])
    signs[signs == 0] = 1.0
    return axes * signs[:, None]


class _Projection(Operator):
    family = "feature engineering"
    contract = "c_t"
    suffix = "_pca"

    def size(self, n: int, p: int) -> int:
        return min(n, p)

    def columns(self, t: Table, state: dict) -> dict[str, Column]:
        axes, mean = np.array(state["axes"]), np.array(state["mean"])
        x = [t.number(n) - F.lit(float(m)) for n, m in zip(t.features, mean)]
        names = [n + self.suffix for n in t.features[: len(axes)]]
        return dict(zip(names, affine(x, axes, np.zeros(len(axes)))))


@register
class PcaFull(_Projection):
    name = "pca_full"
    suffix = "_pcalpck"

    def learn(self, t):
        m = moments(t)
        variance, axes = principal_axes(m)
        k = self.size(m.n, len(t.features))
        total = float(variance.sum()) or 1.0
        return {
            "axes": axes[:k].tolist(),
            "mean": m.mean.tolist(),
            "variance": variance[:k].tolist(),
            "ratio": (variance[:k] / total).tolist(),
        }


@register
class PcaArpack(PcaFull):
    """One component fewer than the full decomposition."""

    name = "pca_arpack"
    contract = "c_t_arpck"
    suffix = "_pcaarpck"

    def size(self, n, p):
        return min(n, p) - 1


@register
class PcaIncremental(PcaFull):
    """Same axes from mergeable statistics; see ``tabloom.streaming.pca`` for batches."""

    name = "pca_incremental"
    suffix = "_pcaincrmnt"


@register
class KernelPca(PcaFull):
    """Linear kernel: its scores are PCA scores, so no n x n matrix is formed."""

    name = "kernel_pca"
    contract = "c_t_krnl"
    suffix = "_pcakrnl"

    def size(self, n, p):
        return min(n, int(0.5 * p))


@register
class PcaRandomized(_Projection):
    """Block subspace iteration from a random start (Halko, Martinsson & Tropp 2011).

    Each pass computes sum x (x . q) for a p x l block ``q``, so neither the driver nor a task holds a p x p
    matrix. Passes go on until the leading axes stand still to ``tol`` or for ``passes``; ``converged`` in the
    state tells which. The last pass projects the rows: ``solver="gram"`` takes the l x l moments of the projected
    rows, ``solver="qr"`` (the default) the triangle of a tall-skinny QR, reduced in tasks and then pairwise in
    groups of tasks, which keeps small variances that squares would lose. Axes, mean, variance and ratio are the
    same kind of state at every width.
    """

    name = "pca_randomized"
    suffix = "_pcarndmzd"
    oversample = 10

    def size(self, n, p):
        return min(n, p, self.params.get("components", p))

    def learn(self, t):
        p = len(t.features)
        solver = self.params.get("solver", "qr")
        if solver not in ("qr", "gram"):
            raise ValueError(f"pca_randomized: no solver {solver!r}")
        data = numbers(t)
        n, mean, total = _spread(data)
        k = self.size(n, p)
        width = min(p, k + self.oversample)
        q = np.linalg.qr(np.random.default_rng(self.params.get("seed", 0)).standard_normal((p, width)))[0]
        converged, passes = width == p, 0
        while not converged and passes < self.params.get("passes", 50):
            product = _gram_product(data, mean, q)
            small = q.T @ product
            _, vectors = np.linalg.eigh((small + small.T) / 2)
            ritz = vectors[:, ::-1][:, :k]
            # what the block leaves out of the leading axes' images, over the largest image
            left = product @ ritz - q @ (small @ ritz)
            converged = bool(np.linalg.norm(left, axis=0).max() <= self.params.get("tol", 1e-9) * max(np.linalg.norm(small, 2), 1e-300))
            q = np.linalg.qr(product)[0]
            passes += 1
        if not converged:
            warnings.warn(f"pca_randomized: axes still moved after {passes} passes", stacklevel=2)
        if solver == "qr":
            _, values, turn = np.linalg.svd(tall_skinny_r(data, mean, q))
            variance, axes = values**2, turn @ q.T
        else:
            small = q.T @ _gram_product(data, mean, q)
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            variance, axes = np.clip(values[::-1], 0, None), (q @ vectors[:, ::-1]).T
        variance = variance[:k] / max(n - 1, 1)
        total = total / max(n - 1, 1) or 1.0
        return {
            "axes": fix_signs(axes[:k]).tolist(),
            "mean": mean.tolist(),
            "variance": variance.tolist(),
            "ratio": (variance / total).tolist(),
            "passes": passes,
            "converged": converged,
        }


def _spread(data: DataFrame) -> tuple[int, np.ndarray, float]:
    """Rows, means, and the sum of squared deviations of all features, in two Arrow passes: no expression grows with the width."""
    p = len(data.columns)
    sums = _sum_arrays(data, p + 1, lambda x: np.append(x.sum(axis=0), len(x)))
    n, mean = int(sums[-1]), sums[:-1] / max(sums[-1], 1.0)
    return n, mean, float(_sum_arrays(data, 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0])


#: Triangles that one task stacks and reduces.
FAN_IN = 16


def tall_skinny_r(data: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The triangle R of the centred rows times ``q``: R'R are their l x l moments.

    A task reduces its batches to one triangle; triangles are stacked ``FAN_IN`` at a time until one is left, so
    no task and not the driver holds more than that many, whatever the number of partitions.
    """
    p, width = q.shape

    def merged(held: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(held, mode="r")
        return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for pdf in batches:
            if len(pdf):
                r = merged(np.vstack([r, (number_matrix(pdf, p) - mean) @ q]))
        if len(r):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [r.tobytes()]})

    def stack(rows: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, width))
        for other in rows.sort_values("part")["r"]:
            r = merged(np.vstack([r, np.frombuffer(other).reshape(width, width)]))
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN_IN], "r": [r.tobytes()]})

    first = data.mapInPandas(partial, "part int, r binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        last = first.agg(F.max("part")).first()[0]
        if last is None:
            return np.zeros((width, width))
        parts, count = first, last + 1
        while count > 1:
            parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInPandas(stack, "part int, r binary")
            count = -(-count // FAN_IN)
        (row,) = parts.collect()  # one triangle
    finally:
        first.unpersist()
    return np.frombuffer(row["r"]).reshape(width, width)


def numbers(t: Table) -> DataFrame:
    """The features as doubles __x0.., built once for all passes: as text, since wide tables are slow to build call by call."""
    kinds = {f.name: f.dataType for f in t.df.schema.fields}
    cells = []
    for i, name in enumerate(t.features):
        value = f"CAST(`{name.replace('`', '``')}` AS DOUBLE)"
        floating = isinstance(kinds[name], (T.DoubleType, T.FloatType))
        cells.append(f"{f'nanvl({value}, CAST(NULL AS DOUBLE))' if floating else value} AS __x{i}")
    return t.df.selectExpr(*cells)


def _sum_arrays(data: DataFrame, width: int, block) -> np.ndarray:
    """Sum over all rows of ``block(x)``: per-partition sums, then a keyed aggregate. ``data`` comes from ``numbers``."""
    p = len(data.columns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                part = block(number_matrix(pdf, p))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"s": [total.ravel()]})

    cells = (
        data.mapInPandas(partial, "s array<double>")
        .select(F.posexplode("s").alias("i", "s"))
        .groupBy("i")
        .agg(F.sum("s").alias("s"))
    )
    out = np.zeros(width)
    for r in cells.collect():  # ``width`` numbers
        out[r["i"]] = r["s"]
    return out


def _gram_product(data: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    def block(x):
        centred = x - mean
        return centred.T @ (centred @ q)

    return _sum_arrays(data, q.size, block).reshape(q.shape)


@register
class TruncatedSvd(_Projection):
    """Largest right singular vectors of the raw (not centred) rows."""

    name = "truncated_svd"
    contract = "c_t_krnl"
    suffix = "_pcatrnckd"

    def learn(self, t):
        m = moments(t, centre=False)
        _, axes = principal_axes(m)
        k = int(0.5 * len(t.features))
        return {"axes": axes[:k].tolist(), "mean": [0.0] * len(t.features)}


@register
class FastIca(_Projection):
    """Parallel fixed point with the log-cosh contrast.

    Rows are whitened by an expression; every iteration is one aggregate of
    E[z g(wz)] and E[g'(wz)], after which the driver decorrelates p x p.
    """

    name = "fast_ica"
    suffix = "_fstica"

    def learn(self, t):
        p = len(t.features)
        m = moments(t)
        white = whitening(m.covariance)
        k = len(white)
        x = [t.number(n) - F.lit(float(v)) for n, v in zip(t.features, m.mean)]
        z = t.derive({f"z{i}": col for i, col in enumerate(affine(x, white, np.zeros(k)))})
        kept = z.df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            data = numbers(z.with_df(kept))
            w = _decorrelate(np.random.default_rng(self.params.get("seed", 0)).standard_normal((k, k)))
            for step in range(self.params.get("max_iter", 200)):
                new = _decorrelate(self._step(data, w, m.n))
                moved = np.max(np.abs(np.abs(np.sum(new * w, axis=1)) - 1))
                w = new
                if moved < self.params.get("tol", 1e-4):
                    break
        finally:
            kept.unpersist()
        return {"axes": (w @ white).tolist(), "mean": m.mean.tolist(), "iterations": step + 1}

    @staticmethod
    def _step(data: DataFrame, w: np.ndarray, n: int) -> np.ndarray:
        k = len(w)

        def block(rows):
            g = np.tanh(rows @ w.T)
            return np.concatenate([(g.T @ rows).ravel(), (1 - g * g).sum(axis=0)])

        total = _sum_arrays(data, k * k + k, block) / n
        return total[: k * k].reshape(k, k) - total[k * k :][:, None] * w


def _decorrelate(w: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(w)
    return u @ v


@register
class RandomTreesEmbedding(Operator):
    """Leaf membership of totally random trees, one-hot.

    Trees grow level by level: one aggregate gives the feature ranges of every
    open node, then feature and cut point are drawn from a seed. A row is routed
    by an expression over literal arrays.
    """

    name = "random_trees_embedding"
    family = "feature engineering"
    contract = "c_t"

    def learn(self, t):
        trees, depth = self.params.get("trees", 10), self.params.get("depth", 5)
        rng = random.Random(self.params.get("seed", 0))
        split = [{} for _ in range(trees)]  # node -> (feature index, cut)
        numbers, p = cut_lineage(t.df.select(*number_columns(t, t.features))), len(t.features)
        for level in range(depth):
            for (tree, node), (n, low, high) in sorted(self._ranges(numbers, p, split, level).items()):
                if node < 2**level:
                    continue
                open_features = [i for i in range(len(low)) if low[i] < high[i]]
                if n < 2 or not open_features:
                    continue
                f = rng.choice(open_features)
                split[tree][node] = (f, rng.uniform(low[f], high[f]))
        leaves = sorted(self._ranges(numbers, p, split, depth))  # at most trees * 2 ** depth
        return {"split": [{str(k): v for k, v in s.items()} for s in split], "depth": depth, "leaves": [list(v) for v in leaves]}

    @staticmethod
    def _route(split: dict, node: int = 1) -> Column:
        """Nested conditions from the root down over columns __x0.., compiled to branches."""
        if node not in split:
            return F.lit(node)
        f, cut = split[node]
        right = RandomTreesEmbedding._route(split, 2 * node + 1)
        left = RandomTreesEmbedding._route(split, 2 * node)
        return F.when(F.col(f"__x{f}") > F.lit(cut), right).otherwise(left)

    def _routes(self, split: list[dict]) -> Column:
        return F.array(*[self._route(s) for s in split])

    @staticmethod
    def _ranges(numbers: DataFrame, p: int, split: list[dict], depth: int) -> dict:
        """(tree, node): rows, lowest and highest value of each feature, of the nodes where rows end after ``depth`` splits.

        A task routes its batches through all trees and hands over one row per node.
        """
        feature = np.full((len(split), 2 ** (depth + 1)), -1)
        cut = np.zeros(feature.shape)
        for tree, nodes in enumerate(split):
            for node, (f, v) in nodes.items():
                feature[tree, node], cut[tree, node] = f, v

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = np.zeros(feature.shape, np.int64)
            low, high = np.full((*feature.shape, p), np.inf), np.full((*feature.shape, p), -np.inf)
            for pdf in batches:
                x = number_matrix(pdf, p)
                for tree in range(len(split)):
                    node = np.ones(len(x), np.int64)
                    for _ in range(depth):
                        f = feature[tree, node]
                        goes = x[np.arange(len(x)), f] > cut[tree, node]
                        node = np.where(f >= 0, 2 * node + goes, node)
                    order = np.argsort(node, kind="stable")
                    starts = np.flatnonzero(np.diff(node[order], prepend=-1))
                    if len(starts):
                        own, sorted_ = node[order][starts], x[order]
                        rows[tree, own] += np.diff(np.append(starts, len(x)))
                        low[tree, own] = np.fmin(low[tree, own], np.fmin.reduceat(sorted_, starts, axis=0))
                        high[tree, own] = np.fmax(high[tree, own], np.fmax.reduceat(sorted_, starts, axis=0))
            trees, nodes = np.nonzero(rows)
            out = {"tree": trees, "node": nodes, "n": rows[trees, nodes]}
            out |= {f"{a}{i}": v[trees, nodes, i] for i in range(p) for a, v in (("a", low), ("b", high))}
            yield pd.DataFrame(out)

        ends = ", ".join(f"{a}{i} double" for i in range(p) for a in "ab")
        aggs = [f(f"{a}{i}").alias(f"{a}{i}") for i in range(p) for f, a in ((F.min, "a"), (F.max, "b"))]
        found = numbers.mapInPandas(run, f"tree int, node int, n long, {ends}").groupBy("tree", "node").agg(F.sum("n").alias("n"), *aggs).collect()
        return {(r["tree"], r["node"]): (r["n"], [r[f"a{i}"] for i in range(p)], [r[f"b{i}"] for i in range(p)]) for r in found}

    def apply(self, t, state):
        code = "".join(n[0] for n in t.features)[:10]
        split = [{int(k): tuple(v) for k, v in s.items()} for s in state["split"]]
        # Each tree is routed once per row; the leaf columns only compare.
        numbers = t.df.select("*", *number_columns(t, t.features))
        routed = t.with_df(numbers.withColumn("__leaf", self._routes(split)))
        return routed.derive(
            {
                f"{j}_rfembdng{code}": F.when(F.get("__leaf", F.lit(tree)) == node, 1.0).otherwise(0.0)
                for j, (tree, node) in enumerate(state["leaves"])
            }
        )
