"""Trust-region Newton steps for many linear problems in one set of passes (Lin, Weng & Keerthi 2008).

A problem is (C, left-out fold, class). A pass over the rows adds up losses and gradients, or products of
Hessians with one vector per problem, of all problems at once; conjugate gradients solve for the steps. No matrix
of features by features exists anywhere: a task and the driver hold a few numbers per problem and feature.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tabloom.functions.stats import number_matrix

#: Rows of a packed block: a few MB at some hundred features.
BLOCK_ROWS = 4096
#: Sums that a task hands over in one row.
CHUNK = 4096


@dataclass(frozen=True)
class Problem:
    """Class ``target`` against the rest, rows of fold ``skip`` left out, penalty 1 / (2 C) of the squared weights."""

    C: float
    skip: int
    target: int


@dataclass
class Solution:
    """Weights (features, then intercept) on the standardised scale, a row per problem.

    ``gradient`` is the norm of each problem's gradient over its norm at zero weights.
    """

    weights: np.ndarray
    gradient: np.ndarray
    steps: int
    converged: bool


def logistic(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log(1 + exp(-m)), its first and its second derivative."""
    loss = np.logaddexp(0.0, -margin)
    p = np.exp(-np.logaddexp(0.0, margin))
    return loss, -p, p * (1 - p)


def squared_hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(0, 1 - m) squared, its first and its generalised second derivative."""
    short = np.maximum(0.0, 1 - margin)
    return short * short, -2 * short, 2.0 * (short > 0)


def packed(data: DataFrame, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Blocks of standardised rows with a column of ones: x, k, fold as bytes. ``data`` has __x0.., k and fold."""
    p = len(mean)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at : at + BLOCK_ROWS]
                x = np.ones((len(part), p + 1))
                x[:, :-1] = (number_matrix(part, p) - mean) / scale
                k, fold = part["k"].to_numpy(np.int32), part["fold"].to_numpy(np.int32)
                yield pd.DataFrame({"x": [x.tobytes()], "k": [k.tobytes()], "fold": [fold.tobytes()]})

    return data.mapInPandas(pack, "x binary, k binary, fold binary").persist(StorageLevel.MEMORY_AND_DISK)


def _sums(blocks: DataFrame, width: int, p: int, block: Callable) -> np.ndarray:
    """``width`` numbers: ``block(x, k, fold)`` added up over all blocks, in each task and then by chunk."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for pdf in batches:
            for x, k, fold in zip(pdf["x"], pdf["k"], pdf["fold"]):
                total += block(np.frombuffer(x).reshape(-1, p), np.frombuffer(k, np.int32), np.frombuffer(fold, np.int32))
        cuts = range(0, width, CHUNK)
        yield pd.DataFrame({"chunk": list(cuts), "s": [total[i : i + CHUNK] for i in cuts]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "s": [np.sum(np.stack(rows["s"].tolist()), axis=0)]})

    parts = blocks.mapInPandas(partial, "chunk int, s array<double>")
    parts = parts.groupBy("chunk").applyInPandas(added, "chunk int, s array<double>")
    out = np.zeros(width)
    for r in parts.collect():
        out[r["chunk"] : r["chunk"] + len(r["s"])] = r["s"]
    return out


class _Penalty:
    """Half the squared weights on the original scale over C; the intercept takes part if asked to."""

    def __init__(self, problems: Sequence[Problem], mean: np.ndarray, scale: np.ndarray, intercept: bool) -> None:
        self.over = 1.0 / np.array([q.C for q in problems])[:, None]
        self.scale, self.shift, self.intercept = scale, mean / scale, intercept

    def gradient(self, w: np.ndarray, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        out = np.zeros_like(w)
        out[:, :-1] = w[:, :-1] / self.scale**2
        if self.intercept:
            raw = w[:, -1:] - w[:, :-1] @ self.shift[:, None]
            out[:, -1:] = raw
            out[:, :-1] -= raw * self.shift
        return out * self.over[rows]

    def diagonal(self) -> np.ndarray:
        own = np.append(1.0 / self.scale**2 + self.intercept * self.shift**2, float(self.intercept))
        return own * self.over


def solve(
    blocks: DataFrame,
    rows: int,
    problems: Sequence[Problem],
    mean: np.ndarray,
    scale: np.ndarray,
    loss: Callable = logistic,
    penalise_intercept: bool = False,
    tolerance: float = 1e-6,
    max_steps: int = 100,
) -> Solution:
    """Minimise sum loss(y * margin) + penalty for every problem, until all gradients are small.

    ``blocks`` comes from ``packed``. Coordinates are scaled by the diagonal that the Hessian has at most, so a
    strong penalty on one feature costs no extra iterations. Where ``max_steps`` ends the work, ``converged`` is
    false and a warning names the largest gradient.
    """
    m, p = len(problems), len(mean) + 1
    skip, target = np.array([q.skip for q in problems]), np.array([q.target for q in problems])
    penalty = _Penalty(problems, mean, scale, penalise_intercept)
    steepest = 2.0 if loss is squared_hinge else 0.25
    d = 1.0 / np.sqrt(penalty.diagonal() + steepest * max(rows, 1))

    def signs(k: np.ndarray, fold: np.ndarray, which: np.ndarray) -> np.ndarray:
        """+1 and -1 by class, 0 for rows of the left-out fold."""
        return np.where(k[:, None] == target[which], 1.0, -1.0) * (fold[:, None] != skip[which])

    def first(u: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = u * d[which]

        def block(x, k, fold):
            y = signs(k, fold, which)
            value, slope, _ = loss(y * (x @ w.T))
            return np.concatenate([(value * (y != 0)).sum(axis=0), ((slope * y).T @ x).ravel()])

        s = _sums(blocks, len(which) * (p + 1), p, block)
        own = penalty.gradient(w, which)
        return s[: len(which)] + 0.5 * (w * own).sum(axis=1), (s[len(which) :].reshape(-1, p) + own) * d[which]

    def second(u: np.ndarray, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        w, dv = u * d[which], v * d[which]

        def block(x, k, fold):
            y = signs(k, fold, which)
            _, _, bend = loss(y * (x @ w.T))
            return ((bend * (y != 0) * (x @ dv.T)).T @ x).ravel()

        return (_sums(blocks, len(which) * p, p, block).reshape(-1, p) + penalty.gradient(dv, which)) * d[which]

    everyone = np.arange(m)
    u = np.zeros((m, p))
    f, g = first(u, everyone)
    start = np.maximum(np.linalg.norm(g, axis=1), 1e-300)
    radius, stalled, step = start.copy(), np.zeros(m, bool), 0
    while step < max_steps:
        which = np.flatnonzero((np.linalg.norm(g, axis=1) > tolerance * start) & ~stalled)
        if not len(which):
            break
        step += 1
        s, gain = _conjugate(second, u, g, radius, which)
        value, slope = first(u[which] + s, which)
        drop = f[which] - value
        good = drop / np.maximum(gain, 1e-300)
        size = np.linalg.norm(s, axis=1)
        radius[which] = np.where(good < 0.25, 0.25 * size, np.where(good > 0.75, np.maximum(radius[which], 2 * size), radius[which]))
        # beyond the precision of the sums the value no longer falls: judge by the gradient
        flat = gain <= 1e-12 * np.abs(f[which])
        better = np.linalg.norm(slope, axis=1) < np.linalg.norm(g[which], axis=1)
        taken = np.where(flat, better, good > 1e-4)
        stalled[which] = flat & ~better
        at = which[taken]
        u[at] += s[taken]
        f[at], g[at] = value[taken], slope[taken]
    rest = np.linalg.norm(g, axis=1) / start
    converged = bool((rest <= tolerance).all())
    if not converged:
        warnings.warn(f"trust-region Newton stopped after {step} steps at a relative gradient of {rest.max():.2g}", stacklevel=2)
    return Solution(u * d, rest, step, converged)


def _conjugate(second: Callable, u: np.ndarray, g: np.ndarray, radius: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the problems ``which`` inside their radii, and the gains that the quadratic model promises.

    A problem leaves when its residual is a tenth of its gradient, or at its radius.
    """
    s = np.zeros((len(which), u.shape[1]))
    r = -g[which]
    v = r.copy()
    goal = 0.1 * np.linalg.norm(r, axis=1)
    active = np.arange(len(which))
    for _ in range(u.shape[1] + 10):
        hv = second(u[which[active]], v[active], which[active])
        rr = (r[active] ** 2).sum(axis=1)
        bend = (v[active] * hv).sum(axis=1)
        alpha = rr / np.maximum(bend, 1e-300)
        new = s[active] + alpha[:, None] * v[active]
        outside = np.linalg.norm(new, axis=1) > radius[which[active]]
        if outside.any():
            so, vo = s[active][outside], v[active][outside]
            sv, vv, ss = (so * vo).sum(axis=1), (vo * vo).sum(axis=1), (so * so).sum(axis=1)
            room = radius[which[active]][outside] ** 2 - ss
            alpha[outside] = room / (sv + np.sqrt(sv * sv + vv * room))
        s[active] += alpha[:, None] * v[active]
        r[active] -= alpha[:, None] * hv
        left = (r[active] ** 2).sum(axis=1)
        v[active] = r[active] + (left / np.maximum(rr, 1e-300))[:, None] * v[active]
        active = active[~outside & (np.sqrt(left) > goal[active])]
        if not len(active):
            break
    # the model's gain: -(g.s) - s.Hs / 2 with Hs = -g - r
    return s, 0.5 * ((-g[which] * s).sum(axis=1) + (r * s).sum(axis=1))
