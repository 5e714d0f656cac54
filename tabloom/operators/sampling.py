"""Balanced, uniform and prioritised samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table, c
from tabloom.functions.keys import WIDE, wide_hash
from tabloom.functions.rank import ROWS_PER_RANGE, running_total
from tabloom.functions.stats import one_row
from tabloom.sources.splits import order_of


def balanced_undersample(t: Table, seed: int = 42, rows_per_range: int = ROWS_PER_RANGE) -> Table:
    """Every class cut to the size of the smallest, by the order of the key hash.

    Hash ranges past the target size are dropped before any sort, so a huge
    class costs one count and one filter.
    """
    sizes = t.df.groupBy(c(t.label)).agg(F.count("*").alias("n"))
    least = sizes.agg(F.min("n")).first()[0] or 0
    hashed = t.df.withColumn("__h", order_of(t, seed))
    placed = running_total(
        hashed, ["__h", *t.key], [t.label], out="__b", stop_at=int(least), rows_per_range=rows_per_range
    )
    return t.with_df(placed.drop("__h", "__b"))


def draws(spark, n: int, seed: int = 42) -> DataFrame:
    """(draw, h): n portable pseudo-random integers in [0, WIDE), made where they are used."""
    numbers = spark.range(n).select(F.col("id").alias("draw"))
    return numbers.withColumn("h", wide_hash(numbers, ["draw"], seed))


def sample_uniform(t: Table, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn with replacement: (draw, row columns)."""
    placed = running_total(t.df, list(t.key), out="__i")
    rows = t.df.count()
    picks = draws(t.df.sparkSession, n, seed).select("draw", F.pmod("h", F.lit(rows)).alias("__i"))
    return picks.join(placed, "__i").drop("__i")


def importance_weight(priority: Column, total: float, least: float, rows: int, alpha: float, beta: float) -> Column:
    """(rows * p)^-beta over the largest such weight."""
    p = F.pow(priority, F.lit(alpha)) / F.lit(total)
    top = (rows * least / total) ** (-beta)
    return F.pow(p * F.lit(float(rows)), F.lit(-beta)) / F.lit(top)


def _priority(t: Table, priority: str) -> Column:
    """Rows without a priority yet get the largest one seen (1 if there is none)."""
    top = one_row(t.df, {"top": F.max(c(priority))})["top"]
    return F.coalesce(c(priority).cast("double"), F.lit(float(top) if top is not None else 1.0))


def sample_prioritized(
    t: Table, priority: str, n: int, alpha: float = 0.6, beta: float = 0.4, seed: int = 42, slots: int | None = None
) -> DataFrame:
    """n draws with probability proportional to priority^alpha, with importance weights.

    Rows occupy consecutive stretches of the total mass; draws and stretches
    meet on equal-width slots, so the range join is an equi-join.
    """
    weighted = t.df.withColumn("__q", _priority(t, priority)).withColumn("__m", F.pow("__q", F.lit(alpha)))
    s = one_row(weighted, {"n": F.count("*"), "t": F.sum("__m"), "a": F.min("__m")})
    placed = running_total(weighted, list(t.key), weight="__m", out="__from")
    slots = slots or max(1, min(1_000_000, n // 100))
    width = s["t"] / slots

    def slot(x: Column) -> Column:
        return F.least(F.floor(x / width), F.lit(slots - 1))

    end = F.col("__from") + F.col("__m")
    spans = placed.withColumn("__end", end).withColumn(
        "__slot", F.explode(F.sequence(slot(F.col("__from")), slot(end)))
    )
    picks = draws(t.df.sparkSession, n, seed).select("draw", (F.col("h") / float(WIDE) * s["t"]).alias("__x"))
    picks = picks.withColumn("__slot", slot(F.col("__x")))
    hit = (F.col("__x") >= F.col("__from")) & (F.col("__x") < F.col("__end"))
    weight = importance_weight(F.col("__q"), s["t"], s["a"], s["n"], alpha, beta)
    found = picks.join(spans, "__slot").where(hit).withColumn("weight", weight)
    return found.drop("__slot", "__x", "__q", "__m", "__from", "__end")


def priority_weights(t: Table, priority: str, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """Key, sampling probability and importance weight of every row."""
    weighted = t.df.withColumn("__q", _priority(t, priority))
    mass = F.pow("__q", F.lit(alpha))
    s = one_row(weighted, {"n": F.count("*"), "t": F.sum(mass), "a": F.min(mass)})
    return weighted.select(
        *[c(k) for k in t.key],
        (mass / s["t"]).alias("probability"),
        importance_weight(F.col("__q"), s["t"], s["a"], s["n"], alpha, beta).alias("weight"),
    )
