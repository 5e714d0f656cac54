"""Shared helpers: tables written to the shared folder, running totals, slices of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.session import ensure_checkpoint_dir

#: White space that separates words, as a character class of Java, Python and RE2 patterns.
BLANK = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    return f"{root}/{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of a query as soon as it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries in it go when each of them ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the written rows.

    The copy cuts the lineage, survives lost executors, and later readers fetch
    only the columns they name. Shuffle files of the write go with its end.
    """
    path = shared_folder(df.sparkSession)
    with short_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(copy: DataFrame) -> None:
    """Remove a copy made by ``stage`` that no later result reads."""
    context = copy.sparkSession.sparkContext
    for folder in {file.rpartition("/")[0] for file in copy.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes that an Arrow batch of texts to a Python worker holds, about.
BATCH_BYTES = 8_000_000


def texts_of(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of ``docs`` on their way to Python workers, in batches bounded by bytes as texts differ much in length."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs.select(*columns)


#: What empties the caches that modules keep in a worker, by the module's name.
caches: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise, and workers are reused."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def empty_caches(keep: str) -> None:
    """Empty the worker's caches but those of the module ``keep``. (By name, as a pickled pass would carry a copy.)"""
    old = [empty for name, empty in caches.items() if name != keep]
    for empty in old:
        empty()
    if old:
        give_back()


def tidy(run: Callable, keep: str = "") -> Callable:
    """A pass over batches that leaves no memory behind: a worker serves one stage after another.

    Caches of other modules than ``keep`` are emptied before it, freed memory is given back after it.
    """

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return passed


def bases(parts: DataFrame, part: str, amount: str) -> DataFrame:
    """Per part: what all smaller parts hold together (``base``), and the ``total`` of all.

    One row per range partition goes through the window, not the rows of the data.
    """
    sums = parts.groupBy(part).agg(F.sum(amount).alias("held"))
    order = Window.orderBy(part)
    return sums.select(
        part,
        (F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("base"),
        F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )


def range_edges(df: DataFrame, column: str, count: int) -> list[int]:
    """``count`` - 1 or fewer cut points of a number; they only balance the parts."""
    if count < 2:
        return []
    marks = [i / count for i in range(1, count)]
    found = df.agg(F.percentile_approx(column, marks, 10_000).alias("edges")).first().edges
    return sorted(set(found or []))


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most`` bytes; one long text is a part of its own."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all runs, one after another."""
    lengths = lengths.astype(np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(int(lengths.sum()))


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ``flat`` as one binary value each, without a copy per run."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts.astype(np.int64) * flat.itemsize, out=offsets[1:])
    data = pa.py_buffer(np.ascontiguousarray(flat))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), data]).cast(pa.binary())


#: Tables of at most so many rows, counted first, are broadcast; larger ones are joined by salted keys.
SMALL, SALTS = 10_000, 32


def join_small(rows: DataFrame, small: DataFrame, on: Column, salted_by: Column, limit: int | None = None) -> DataFrame:
    """Join a table of one row per source, group or class, whose keys may be very uneven in ``rows``."""
    limit = SMALL if limit is None else limit
    if small.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(small), on)
    copies = small.withColumn("copy_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("row_salt", F.pmod(F.xxhash64(salted_by), F.lit(SALTS)).cast("int"))
    return salted.join(copies, on & (F.col("row_salt") == F.col("copy_salt"))).drop("row_salt", "copy_salt")
