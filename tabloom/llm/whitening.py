"""Embedding whitening: a distributed centred covariance, its leading eigenvectors, a projection of all rows.

The fit counts each distinct vector once. Its sums are exact integers; a second pass
adds up products of what is left after the mean is taken off. The covariance, a matrix
of the width squared for any number of rows, is brought to tridiagonal form by
Householder reflections; Sturm counts and bisection give the leading eigenvalues,
inverse iteration their vectors, orthogonalised anew within clusters. The components are
broadcast and every row is projected where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import read, stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a covariance that a task hands over as one value.
BAND = 64
#: Eigenvalues nearer than this part of the largest are one cluster (LAPACK's choice).
CLUSTER = 1e-3
#: Values stay below this in size, so that sums of any table fit into 38 digits.
LARGEST = float(1 << 62)
MOST = 10**38 - 1


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflections (a unit vector a row) of a symmetric matrix; H … H A H … H is tridiagonal."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    reflections = np.zeros((max(0, n - 2), n))
    for k in range(n - 2):
        x = a[k + 1 :, k]
        top = np.abs(x).max(initial=0.0)
        if top == 0.0 or not np.any(x[1:]):
            continue
        v = x / top
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        reflections[k, k + 1 :] = v
        # A - 2 v w' - 2 w v' with w = A v - (v' A v) v
        part = a[k + 1 :, k + 1 :]
        w = part @ v
        w -= (v @ w) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        column = x - 2 * v * (v @ x)
        a[k + 1 :, k] = a[k, k + 1 :] = column
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are below each of ``at``: the negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares = off * off
    q, count = np.ones(len(at)), np.zeros(len(at), np.int64)
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (squares[k - 1] / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each bisected until its bracket is two neighbouring numbers."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    room = np.finfo(float).eps * np.abs(diagonal).max(initial=0.0) * n + np.finfo(float).tiny
    low = np.full(count, (diagonal - reach).min() - room)
    high = np.full(count, (diagonal + reach).max() + room)
    wanted = n - 1 - np.arange(count)  # so many eigenvalues are below it
    for _ in range(2000):
        middle = low + (high - low) / 2
        if not np.any((middle > low) & (middle < high)):
            break
        below = sturm_counts(diagonal, off, middle) > wanted
        high, low = np.where(below, middle, high), np.where(below, low, middle)
    return high


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; pivots are at least ``least`` in size."""
    n = len(diagonal)
    d, x = diagonal - shift, right.copy()
    low, up, second = off.copy(), np.append(off, 0.0), np.zeros(n)
    for k in range(n - 1):
        if abs(d[k]) >= abs(low[k]):
            if abs(d[k]) < least:
                d[k] = np.copysign(least, d[k])
            m = low[k] / d[k]
            d[k + 1] -= m * up[k]
            x[k + 1] -= m * x[k]
        else:
            m = d[k] / low[k]
            d[k], d[k + 1], up[k] = low[k], up[k] - m * d[k + 1], d[k + 1]
            if k + 1 < n - 1:
                second[k], up[k + 1] = up[k + 1], -m * up[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - m * x[k + 1]
    if abs(d[-1]) < least:
        d[-1] = np.copysign(least, d[-1])
    for k in range(n - 1, -1, -1):
        if k + 1 < n:
            x[k] -= up[k] * x[k + 1]
        if k + 2 < n:
            x[k] -= second[k] * x[k + 2]
        x[k] /= d[k]
        big = abs(x[k])
        if big > 1e150:  # only the direction counts
            x /= big
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (a row each) by inverse iteration; those of a cluster are kept orthogonal to the ones before."""
    n = len(diagonal)
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0))
    least = max(np.finfo(float).eps * size, np.finfo(float).tiny)
    out = np.zeros((len(values), n))
    first, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            first = k
        # equal values get shifts a few units apart, so that the systems differ
        shift = value if k == first else min(value, shift - 10 * least)
        x = np.random.default_rng(k + 1).uniform(-1, 1, n)
        best = np.inf
        for _ in range(30):
            for _ in range(2):
                x -= out[first:k].T @ (out[first:k] @ x)
            norm = np.linalg.norm(x)
            x = x / norm if norm else np.eye(n)[k % n]
            product = diagonal * x
            product[:-1] += off * x[1:]
            product[1:] += off * x[:-1]
            rest = np.linalg.norm(product - (x @ product) * x)
            if rest < best:
                best, out[k] = rest, x
            elif best <= 50 * n * least:
                break
            x = solve_shifted(diagonal, off, shift, x, least)
    return out


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows."""
    n = len(matrix)
    count = min(count, n)
    if not count:
        return np.zeros(0), np.zeros((0, n))
    scale = np.abs(matrix).max(initial=0.0)
    if scale == 0.0:
        return np.zeros(count), np.eye(n)[:count]
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, count)
    vectors = vectors_of(diagonal, off, values)
    for v in reflections[::-1]:
        vectors -= 2 * np.outer(vectors @ v, v)
    return values * scale, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass
class Whitener:
    """What is known of the vectors of one width: sums, number, and the leading components of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S exactly: int64 where it fits, Python integers elsewhere."""
        largest = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if largest < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; NaN where the covariance has no such direction."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = (centred / self.n).astype(np.float64) @ self.axes.T
            return np.where(self.values > 0, scores / np.sqrt(self.values), np.nan)

    def deviations(self, centred: np.ndarray) -> list[int]:
        """Sum of the squares of each row, exactly, or ``MOST`` where that has more digits."""
        if centred.dtype != object and float(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 2**62:
            return (centred * centred).sum(axis=1).tolist()
        wide = centred.astype(object)
        return [min(MOST, v) for v in (wide * wide).sum(axis=1).tolist()]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long): rows whose vector is there and finite, scaled and shifted."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & fine)
    near = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))
    x = F.transform("embedding", lambda c: F.floor(near(c)).cast("long") + SHIFT)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the batch's rows of each width, and their vectors as a matrix."""
    column = batch.column("x")
    widths = pc.list_value_length(column).to_numpy()
    flat, starts = column.flatten().to_numpy(), np.cumsum(widths) - widths
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield rows, flat[starts[rows][:, None] + np.arange(width)]


def totals(fit_list: DataFrame) -> DataFrame:
    """width, place, total (exact) of each dimension, and at place -1 the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in by_width(batch):
                own = held.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                high, low = x >> 31, x & ((1 << 31) - 1)  # halves, so that no batch overflows
                own[0] += len(x)
                own[1] = own[1] + high.sum(axis=0).astype(object) * (1 << 31) + low.sum(axis=0).astype(object)
        for width, (n, sums) in held.items():
            values = [Decimal(n), *(Decimal(int(s)) for s in sums)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * len(values), pa.int32()), pa.array(range(-1, width), pa.int32()), pa.array(values, pa.decimal128(38, 0))],
                ["width", "place", "total"],
            )

    parts = fit_list.select("x").mapInArrow(run, "width int, place int, total decimal(38,0)")
    return parts.groupBy("width", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


def products(fit_list: DataFrame, known: dict[int, Whitener], whiten: bool) -> dict[int, np.ndarray]:
    """Per width the sum of the products of all pairs of dimensions, of centred vectors or of whitened ones.

    Tasks add up their own vectors and hand over bands of rows of the matrix; bands are
    added by a few tasks each before one adds what these have.
    """
    shared = fit_list.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        task = 0
        for batch in batches:
            for _, x in by_width(batch):
                own = shared.value[x.shape[1]]
                centred = own.centred(x)
                rows = own.whitened(centred) if whiten else (centred / own.n).astype(np.float64)
                held[x.shape[1]] = held.get(x.shape[1], 0.0) + rows.T @ rows
                task = (task * 31 + int(x[0, 0] if x.size else 0)) & 0xFFFF
        for width, matrix in held.items():
            starts = range(0, len(matrix), BAND)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([width] * len(starts), pa.int32()), pa.array(starts, pa.int32()),
                    pa.array([task % 64] * len(starts), pa.int32()), pa.array([matrix[s : s + BAND].tobytes() for s in starts], pa.binary()),
                ],
                ["width", "first", "salt", "band"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for width, first, salt, band in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                value = np.frombuffer(band)
                held[width, first, salt] = held[width, first, salt] + value if (width, first, salt) in held else value
        keys = list(held)
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([held[k].tobytes() for k in keys], pa.binary())], ["width", "first", "salt", "band"])

    kinds = "width int, first int, salt int, band binary"
    parts = fit_list.select("x").mapInArrow(run, kinds)
    for keys in (["width", "first", "salt"], ["width", "first"]):
        parts = parts.repartition(*keys).mapInArrow(add, kinds)
        parts = parts.withColumn("salt", F.lit(0)) if len(keys) == 3 else parts
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.toLocalIterator():
        out.setdefault(r.width, {})[r.first] = np.frombuffer(r.band)
    side = {w: len(own.values) if whiten else w for w, own in known.items()}
    return {w: np.concatenate([bands[s] for s in sorted(bands)]).reshape(side[w], side[w]) for w, bands in out.items()}


def fit(rows: DataFrame, count: int = COMPONENTS) -> dict[int, Whitener]:
    """Per width of vectors its whitener; ``rows`` has x. Only sums and matrices of the width come to the driver."""
    fit_list = stage(rows.filter(F.size("x") > 0).select("x").groupBy("x").agg(F.count(F.lit(1)).alias("times")).select("x"))
    sums: dict[int, dict[int, int]] = {}
    for r in totals(fit_list).toLocalIterator():
        sums.setdefault(r.width, {})[r.place] = int(r.total)
    known = {
        w: Whitener(s[-1], [s[k] for k in range(w)], np.zeros(0), np.zeros((0, w)), 0.0) for w, s in sums.items()
    }
    for w, matrix in products(fit_list, known, whiten=False).items():
        own = known[w]
        covariance = matrix / own.n
        covariance = (covariance + covariance.T) / 2
        own.trace = float(np.trace(covariance))
        values, own.axes = leading_pairs(covariance, count)
        # what is left of a direction without any spread is rounding
        own.values = np.where(values > own.trace * w * np.finfo(float).eps, values, 0.0)
    for w, matrix in products(fit_list, known, whiten=True).items():
        there = known[w].values > 0
        error = (matrix / known[w].n - np.eye(len(there)))[np.ix_(there, there)]
        known[w].identity_error = float(np.abs(error).max(initial=0.0))
    return known


def whiten(vectors: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component int (from 1), n long, deviation decimal, whitened, explained, identity_error double.

    ``vectors`` has vec_id and embedding. Entries c become floor(64 c) + 1,000,000 (64 c
    within 2^62). Rows with a null vector, or null or non-finite entries, are dropped; other rows,
    repeated or without vec_id, each have their rows. Vectors of each width are fitted and
    whitened on their own, empty ones give no rows. Where the covariance has
    fewer directions than components, ``whitened`` is null and ``explained`` 0 in the others, and
    ``identity_error`` leaves them out. Further columns are ignored; an empty table gives no rows.
    """
    rows = usable(vectors)
    known = fit(rows, count)
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_width(batch):
                own = shared.value[x.shape[1]]
                centred = own.centred(x)
                scores = own.whitened(centred)
                k, n = scores.shape[1], len(x)
                deviation = pa.array([Decimal(v) for v in own.deviations(centred)], pa.decimal128(38, 0))
                every = np.repeat(np.arange(n), k)
                explained = own.values / own.trace if own.trace > 0 else np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(at[every])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, own.n)), deviation.take(pa.array(every)), pa.array(scores.ravel(), from_pandas=True),
                        pa.array(np.tile(explained, n)), pa.array(np.full(n * k, own.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return rows.filter(F.size("x") > 0).mapInArrow(run, kinds)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on 16 components. A deviation that has no 64 bits (from some 10^8 vectors on) is null here."""
    out = whiten(read(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
