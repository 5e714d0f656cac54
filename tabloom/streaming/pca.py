"""Principal components from mergeable statistics, batch by batch.

Each micro-batch adds one row (count, sums, products) to a statistics table;
the axes are solved from the merged table at any time. A batch that is replayed
after a failure overwrites its own row, so nothing counts twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tabloom.frame import Table
from tabloom.functions.stats import Moments, moments
from tabloom.operators.decompose import principal_axes


def batch_statistics(t: Table, shift: np.ndarray | None = None) -> dict:
    """Count, sums and products of ``x - shift``; a shift near the mean keeps precision."""
    m = moments(t)
    p = len(t.features)
    shift = np.zeros(p) if shift is None else shift
    gap = m.mean - shift
    return {
        "n": m.n,
        "sums": (m.n * gap).tolist(),
        "products": (m.scatter + m.n * np.outer(gap, gap)).ravel().tolist(),
    }


def merge(stats: DataFrame, p: int, shift: np.ndarray | None = None) -> Moments:
    """Moments of all batches together; ``stats`` has columns n, sums, products."""
    shift = np.zeros(p) if shift is None else shift
    n = stats.agg(F.sum("n")).first()[0]

    def total(column: str, size: int) -> np.ndarray:
        cells = stats.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        out = np.zeros(size)
        for r in cells.collect():  # p or p * p numbers
            out[r["i"]] = r["v"]
        return out

    gap = total("sums", p) / n
    scatter = total("products", p * p).reshape(p, p) - n * np.outer(gap, gap)
    return Moments(int(n), gap + shift, scatter)


def incremental_axes(stats: DataFrame, p: int, shift: np.ndarray | None = None):
    m = merge(stats, p, shift)
    return m, *principal_axes(m)


class IncrementalPca:
    """A ``foreachBatch`` sink that writes one statistics row per micro-batch."""

    def __init__(self, like: Table, path: str, shift: np.ndarray | None = None):
        self.like, self.path, self.shift = like, path, shift

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if not batch.take(1):
            return
        stats = batch_statistics(self.like.with_df(batch), self.shift)
        row = batch.sparkSession.createDataFrame(
            [(stats["n"], stats["sums"], stats["products"])], "n bigint, sums array<double>, products array<double>"
        )
        row.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def axes(self, spark):
        stats = spark.read.parquet(self.path)
        return incremental_axes(stats, len(self.like.features), self.shift)
