"""Blocks of queries on their way to blocks of rows that stay where they were dealt to.

Rows are packed into vertical blocks and dealt to slices, each of a bounded size that a task
holds; blocks of queries are sent to every slice of their width. So rows move once,
and queries, a small part of the table, as often as there are slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm.common import partitions, tidy

#: Queries of a block, rows of a block, bytes of the vectors of a slice.
QUERIES_IN_BLOCK, ROWS_IN_BLOCK, SLICE_BYTES = 256, 2048, 32_000_000
BLOCK = "width int, rows int, longs binary, vectors binary"


def finite(vector: str) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of each entry as a double, which holds these integers exactly."""

    def whole(x: Column) -> Column:
        # from 2^52 on every double is an integer; below, a long holds the floor
        return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)

    return F.transform(vector, lambda x: whole(x.cast("double") * scale))


def packed(rows: DataFrame, longs: list[str], size: int) -> DataFrame:
    """``BLOCK`` rows: at most ``size`` rows of one width, their ``longs`` side by side and their vectors as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("vector")
            lengths = pc.list_value_length(column).to_numpy()
            flat, starts = column.flatten().to_numpy(), np.cumsum(lengths) - lengths
            numbers = np.stack([batch.column(c).to_numpy() for c in longs]).astype(np.int64)
            for width in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == width)
                for part in np.split(at, range(size, len(at), size)):
                    values = flat[starts[part][:, None] + np.arange(width)[None, :]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([width], pa.int32()), pa.array([len(part)], pa.int32()),
                            pa.array([numbers[:, part].tobytes()]), pa.array([values.tobytes()]),
                        ],
                        ["width", "rows", "longs", "vectors"],
                    )

    return rows.select(*longs, "vector").mapInArrow(tidy(run), BLOCK)


def unpacked(width: int, rows: int, longs: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers (a row per column packed) and the vectors (a row each) of a block."""
    return np.frombuffer(longs, np.int64).reshape(-1, rows), np.frombuffer(vectors, np.float64).reshape(rows, width)


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The leanest type in which inner products of the rows of ``a`` and ``b``, integers in doubles, are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if most < 2**52 else np.int64 if most < 2**62 else object


def as_kind(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is object:
        return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)
    return values.astype(kind, copy=False)


def visit(rows: DataFrame, row_longs: list[str], queries: DataFrame, query_longs: list[str],
          search: Callable, schema: str, slices: int | None = None, slice_bytes: int | None = None) -> DataFrame:
    """What ``search(resident, block)`` yields for each slice of rows and each block of queries of the same width.

    ``rows`` and ``queries`` have a column ``vector`` (array of double) and their longs.
    ``resident`` is a list of (longs, vectors) of the slice, ``block`` one such pair. A task
    holds one slice and one block at a time. The number of slices is counted, so that a
    slice's vectors have about ``SLICE_BYTES``.
    """
    spark = rows.sparkSession
    most = slice_bytes or SLICE_BYTES
    asked = packed(queries, query_longs, QUERIES_IN_BLOCK)
    held = packed(rows, row_longs, ROWS_IN_BLOCK)
    # one row for each width of vectors; W widths need some 4 W^2 bytes of vectors, so they are few for any table
    sizes = rows.groupBy(F.size("vector").alias("of_width")).agg(F.count(F.lit(1)).alias("n"))
    least = slices or min(partitions(spark), spark.sparkContext.defaultParallelism)
    needed = F.greatest(F.lit(least), F.ceil(F.col("n") * F.col("of_width") * 8 / most)).cast("int")
    sizes = F.broadcast(sizes.select("of_width", needed.alias("slices")))
    place = F.pmod(F.xxhash64("longs"), F.col("slices")).cast("int")
    resident = held.join(sizes, F.col("width") == F.col("of_width")).select(place.alias("slice"), F.lit(0).alias("kind"), *BLOCK_NAMES)
    visits = asked.join(sizes, F.col("width") == F.col("of_width")).select(
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("kind"), *BLOCK_NAMES
    )
    both = resident.unionByName(visits).repartition(partitions(spark), "width", "slice").sortWithinPartitions("width", "slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, resident = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("slice", "kind", "width", "rows")}
                block = unpacked(r["width"], r["rows"], batch.column("longs")[k].as_buffer(), batch.column("vectors")[k].as_buffer())
                if key != (r["width"], r["slice"]):
                    key, resident = (r["width"], r["slice"]), []
                if r["kind"] == 0:
                    resident.append((block[0].copy(), block[1].copy()))
                elif resident:
                    yield from search(resident, block)

    return both.mapInArrow(tidy(run), schema)


BLOCK_NAMES = [f.split()[0] for f in BLOCK.split(", ")]
