"""Row permutations, samples and folds that depend only on the row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table, c
from tabloom.functions.keys import MODULUS, keyed_hash, wide_hash
from tabloom.functions.rank import running_total


def hash_of(t: Table, seed: int = 42) -> Column:
    return keyed_hash(t.df, t.key, seed)


def order_of(t: Table, seed: int = 42) -> Column:
    """The wide hash that permutations and samples are ordered by."""
    return wide_hash(t.df, t.key, seed)


def shuffle_rows(t: Table, seed: int = 42) -> DataFrame:
    """The table with ``position``: its 0-based place in a seeded permutation."""
    hashed = t.df.withColumn("__h", order_of(t, seed))
    return running_total(hashed, ["__h", *t.key], out="position").drop("__h")


def sample_cap(t: Table, n: int, seed: int = 42) -> Table:
    """The first ``n`` rows of the permutation (a top-n, not a full sort)."""
    hashed = t.df.withColumn("__h", order_of(t, seed))
    return t.with_df(hashed.orderBy("__h", *[c(k) for k in t.key]).limit(n).drop("__h"))


def train_test_split(t: Table, train: float = 0.8, seed: int = 42) -> tuple[Table, Table]:
    """Two filters on the key hash; stable under re-partitioning and re-reading."""
    if train >= 1:
        return t, t.where(F.lit(False))
    in_train = hash_of(t, seed) < F.lit(int(train * MODULUS))
    return t.where(in_train), t.where(~in_train)


def _fold(place: Column, rows: Column, k: int) -> Column:
    """Contiguous folds; the first ``rows mod k`` hold one more row."""
    size = F.floor(rows / k)
    longer = F.pmod(rows, F.lit(k))
    edge = (size + 1) * longer
    return (
        F.when(place < edge, F.floor(place / (size + 1)))
        .otherwise(longer + F.floor((place - edge) / F.greatest(size, F.lit(1))))
        .cast("int")
    )


def kfold(t: Table, k: int = 5) -> Table:
    """Adds ``fold`` 0..k-1: contiguous ranges of the key order."""
    rows = t.df.count()
    placed = running_total(t.df, list(t.key), out="__p")
    return t.with_df(placed.withColumn("fold", _fold(F.col("__p"), F.lit(rows), k)).drop("__p"))


def stratified_kfold(t: Table, k: int = 2) -> Table:
    """Adds ``fold`` 0..k-1: contiguous ranges of the key order within each class."""
    sizes = t.df.groupBy(c(t.label).alias("__y")).agg(F.count("*").alias("__n"))
    placed = running_total(t.df, list(t.key), [t.label], out="__p")
    joined = placed.join(sizes, placed[t.label].eqNullSafe(sizes["__y"]))
    return t.with_df(joined.withColumn("fold", _fold(F.col("__p"), F.col("__n"), k)).drop("__p", "__n", "__y"))
