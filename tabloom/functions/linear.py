"""Affine maps and arg-max as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Above this many coefficients the map is one Arrow batch product instead of
# generated code, whose size grows with every term.
EXPRESSION_TERMS = 400


def affine(x: Sequence[Column], weights: np.ndarray, intercept: np.ndarray) -> list[Column]:
    """Columns of ``x @ weights.T + intercept``; one per row of ``weights``."""
    weights = np.atleast_2d(np.asarray(weights, dtype=float))
    intercept = np.asarray(intercept, dtype=float)
    k, p = weights.shape
    if k * p <= EXPRESSION_TERMS:
        out = []
        for w, b in zip(weights, intercept):
            total = F.lit(float(b))
            for xi, wi in zip(x, w):
                total = total + xi * F.lit(float(wi))
            out.append(total)
        return out

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def product(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(list(rows.to_numpy(dtype=float) @ weights.T + intercept), dtype=object)

    scores = product(F.struct(*[v.alias(f"x{i}") for i, v in enumerate(x)]))
    return [F.get(scores, F.lit(i)) for i in range(k)]


def squared_distances(x: Sequence[Column], centres: np.ndarray) -> list[Column]:
    centres = np.atleast_2d(np.asarray(centres, dtype=float))
    k, p = centres.shape
    if k * p <= EXPRESSION_TERMS:
        out = []
        for centre in centres:
            total = F.lit(0.0)
            for xi, ci in zip(x, centre):
                d = xi - F.lit(float(ci))
                total = total + d * d
            out.append(total)
        return out

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def distances(rows: pd.DataFrame) -> pd.Series:
        v = rows.to_numpy(dtype=float)
        return pd.Series(list(np.stack([((v - m) ** 2).sum(axis=1) for m in centres], axis=1)), dtype=object)

    found = distances(F.struct(*[v.alias(f"x{i}") for i, v in enumerate(x)]))
    return [F.get(found, F.lit(i)) for i in range(k)]


def first_max(values: Sequence[Column], labels: Sequence) -> Column:
    """The label of the largest value; on ties the first label wins."""
    arr = F.array(*values)
    return F.get(
        F.array(*[F.lit(v) for v in labels]), (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
    )


def first_min(values: Sequence[Column], labels: Sequence) -> Column:
    arr = F.array(*values)
    return F.get(
        F.array(*[F.lit(v) for v in labels]), (F.array_position(arr, F.array_min(arr)) - 1).cast("int")
    )


def softmax(logs: Sequence[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(v - top) for v in logs]
    total = parts[0]
    for v in parts[1:]:
        total = total + v
    return [v / total for v in parts]


def whitening(covariance: np.ndarray) -> np.ndarray:
    """Rows map centred features to uncorrelated unit-variance ones.

    Works on the correlation matrix, so columns of very different scale keep
    their precision; directions without variance are left out.
    """
    scale = np.sqrt(np.clip(np.diag(covariance), 0, None))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
    keep = values > max(values.max(), 0) * 1e-12
    return (vectors[:, keep] / np.sqrt(values[keep])).T / scale
