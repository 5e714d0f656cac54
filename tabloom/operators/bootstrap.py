"""Balanced bootstraps as counts per row and tree, drawn without moving rows between classes.

Each tree draws as many rows of every class as the smallest class has, with
replacement. A multinomial draw splits that number over buckets of rows (a chain of
conditional binomials, so the parts add up exactly), and each bucket deals its part to its
own rows. Buckets come from a hash of the key, so any partitioning gives the same counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.frame import Table, c
from tabloom.functions.keys import wide_hash
from tabloom.functions.stats import class_index
from tabloom.session import cut_lineage

#: Rows of a bucket, about, as long as there are no more buckets than this.
BUCKET_ROWS, BUCKETS = 50_000, 1 << 16


def balanced_bootstrap(t: Table, labels: list, trees: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Key columns, x array<double>, y int (place in ``labels``), w array<int>: how often each tree draws the row.

    Rows without class are left out. The key must name one row.
    """
    spark = t.df.sparkSession
    numbers = F.array(*[t.number(n) for n in t.features])
    rows = t.df.select(*[c(n) for n in t.key], wide_hash(t.df, t.key, seed).alias("__h"), numbers.alias("x"), class_index(t, labels).cast("int").alias("y"))
    rows = cut_lineage(rows.where(F.col("y").isNotNull()))
    buckets = int(min(BUCKETS, max(1, -(-rows.count() // bucket_rows))))
    placed = rows.withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("int"))
    held = np.zeros((buckets, len(labels)), np.int64)
    for r in placed.groupBy("__b", "y").agg(F.count("*").alias("n")).toLocalIterator():  # buckets times classes
        held[r["__b"], r.y] = r.n
    total = held.sum(axis=0)
    there = np.flatnonzero(total)
    least = int(total[there].min()) if len(there) else 0
    draws = np.zeros((buckets, trees, len(labels)), np.int64)
    for k in there.tolist():
        for tree in range(trees):
            draws[:, tree, k] = np.random.default_rng([seed, tree, k]).multinomial(least, held[:, k] / total[k])
    parts = spark.createDataFrame([(b, draws[b].tobytes()) for b in range(buckets)], "__b int, draws binary")
    keys = list(t.key)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in keys)

    def deal(table: pa.Table, part: pa.Table) -> pa.Table:
        out = [n for n in table.column_names if n not in ("__h", "__b")]
        table = table.sort_by("__h")
        y = table.column("y").to_numpy()
        w = np.zeros((len(y), trees), np.int32)
        if len(y):
            bucket = table.column("__b")[0].as_py()
            own = np.frombuffer(part.column("draws")[0].as_py(), np.int64).reshape(trees, -1)
            for k in np.unique(y).tolist():
                rows = np.flatnonzero(y == k)
                for tree in range(trees):
                    drawn = np.random.default_rng([seed, tree, k, bucket]).integers(0, len(rows), own[tree, k])
                    w[rows, tree] = np.bincount(drawn, minlength=len(rows))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, trees, dtype=np.int32)), pa.array(w.ravel()))
        return table.select(out).append_column("w", lists)

    met = placed.groupBy("__b").cogroup(parts.groupBy("__b"))
    return met.applyInArrow(deal, f"{kinds}, x array<double>, y int, w array<int>")
