"""Ranks, prefix sums and exact quantiles without a single-partition sort.

A global window (no ``partitionBy``) pulls the table into one task. Here the
order column is cut into ranges, every range is totalled by a partial
aggregate, and only the small table of range totals is windowed; inside a
range an ordinary window runs in parallel. Range edges come from a sample and
influence only the balance of the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabloom.frame import c

ROWS_PER_RANGE = 1_000_000
# So few rows are one range, which is one task; more are cut into at least one per shuffle partition.
ONE_RANGE = 4096
SAMPLED_PER_RANGE = 64
EXACT_DISTINCT = 1_000_000
# ``percentile`` walks all distinct values once per probability.
PERCENTILE_STEPS = 20_000_000
# Longer edge lists are searched in a literal array: nested conditions would
# outgrow the size limit of generated methods.
NESTED_EDGES = 8
_B, _O = "__range", "__offset"


def range_edges(df: DataFrame, order: Sequence[str], ranges: int, rows: int) -> list[tuple]:
    """At most ``ranges - 1`` ascending cut points of the order, as tuples of its columns.

    They come from a bounded sample of the whole order tuple: where one value of
    the leading column holds many rows, the further columns cut it.
    """
    if ranges <= 1:
        return []
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(rows, 1))
    drawn = df.select(*[c(o) for o in order]).sample(False, share, 7).collect()
    tuples = sorted(tuple(r) for r in drawn if all(v is not None for v in r))
    if not tuples:
        return []
    return sorted({tuples[len(tuples) * i // ranges] for i in range(1, ranges)})


def range_by_order(order: Sequence[str], edges: Sequence[tuple]) -> Column:
    """Number of edge tuples that are <= the order columns; the first column alone if it suffices."""
    firsts = [e[0] for e in edges]
    if len(order) == 1 or len(set(firsts)) == len(firsts):
        return range_of(c(order[0]), firsts)
    here = F.struct(*[c(o).alias(f"o{i}") for i, o in enumerate(order)])
    step = 64

    def literals(part: Sequence[tuple]) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(e)]) for e in part])

    if len(edges) <= step:
        return F.size(F.filter(literals(edges), lambda e: e <= here))
    block = F.greatest(F.size(F.filter(literals(edges[::step]), lambda e: e <= here)) - 1, F.lit(0))
    fine = F.slice(literals(edges), block * step + 1, step)
    return block * step + F.size(F.filter(fine, lambda e: e <= here))


def literal_array(values: Sequence) -> Column:
    """A constant array column; long numeric lists go over as one string literal."""
    if len(values) > 16 and all(isinstance(v, (int, float)) for v in values):
        text = F.lit(",".join(repr(float(v)) for v in values))
        return F.split(text, ",").cast("array<double>")
    return F.array(*[F.lit(v) for v in values])


def range_of(value: Column, edges: Sequence) -> Column:
    """Number of edges that are <= value; null values count none."""
    step = 64
    if not edges:
        return F.lit(0)
    if len(edges) == 1:
        return F.when(value >= F.lit(edges[0]), 1).otherwise(0)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(edges[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    if len(edges) <= NESTED_EDGES:
        return search(0, len(edges))
    if len(edges) <= step:
        return F.size(F.filter(literal_array(edges), lambda e: e <= value))
    # A coarse step over every 64th edge, then the 64 edges behind it.
    block = F.greatest(F.size(F.filter(literal_array(edges[::step]), lambda e: e <= value)) - 1, F.lit(0))
    fine = F.slice(literal_array(edges), block * step + 1, step)
    return block * step + F.size(F.filter(fine, lambda e: e <= value))


def running_total(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    weight: str | None = None,
    out: str = "before",
    stop_at: int | Column | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``out``: the weight of all rows before this one within its group.

    ``order`` must be a total order. With ``stop_at`` the ranges that start at
    or past it are dropped before the window, so a top-n never sorts the rest.
    """
    w = c(weight) if weight else F.lit(1).cast("bigint")
    rows = df.count()
    ranges = math.ceil(rows / rows_per_range)
    if rows > ONE_RANGE:
        ranges = max(ranges, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = range_edges(df, order, ranges, rows)
    ordered = W.partitionBy(*[c(g) for g in group], F.col(_B)).orderBy(*[c(o) for o in order])
    ranged = df.withColumn(_B, range_by_order(order, edges).cast("int"))
    inside = F.coalesce(F.sum(w).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if not edges:
        done = ranged.withColumn(out, inside)
        if stop_at is not None:
            done = done.where(F.col(out) < stop_at)
        return done.drop(_B)
    names = [*group, _B]
    totals = ranged.groupBy(*[c(n) for n in names]).agg(F.sum(w).alias("__t"))
    across = W.partitionBy(*[c(g) for g in group]) if group else W.partitionBy(F.lit(0))
    offsets = totals.select(
        *[c(n) for n in names],
        F.coalesce(
            F.sum("__t").over(across.orderBy(_B).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias(_O),
    )
    if stop_at is not None:
        offsets = offsets.where(F.col(_O) < stop_at)
    same = [ranged[n].eqNullSafe(offsets[n]) for n in group] + [ranged[_B] == offsets[_B]]
    joined = ranged.join(offsets, same).select(ranged["*"], offsets[_O])
    done = joined.withColumn(out, F.col(_O) + inside).drop(_B, _O)
    return done.where(F.col(out) < stop_at) if stop_at is not None else done


def quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probs: Sequence[float],
    exact_distinct: int = EXACT_DISTINCT,
) -> dict[str, list[float] | None]:
    """Exact linearly interpolated quantiles of several columns; None where all null.

    Spark's ``percentile`` keeps one map of distinct values per column in the
    final task, so it is used only for columns whose distinct count is known
    to be small. The others are counted per value, cut into ranges, and only the
    ranges that hold a wanted rank are sorted.
    """
    probs = [float(p) for p in probs]
    names = list(columns)
    data = df.select(*[columns[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    sizes = data.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))],
        *[F.approx_count_distinct(f"v{i}").alias(f"d{i}") for i in range(len(names))],
    ).first()
    fits = min(exact_distinct, PERCENTILE_STEPS // max(len(probs), 1))
    small = [i for i in range(len(names)) if sizes[f"d{i}"] <= fits]
    large = [i for i in range(len(names)) if i not in small]
    found: dict[str, list[float] | None] = {}
    if small:
        row = data.agg(*[F.percentile(f"v{i}", literal_array(probs)).alias(f"q{i}") for i in small]).first()
        for i in small:
            found[names[i]] = list(row[f"q{i}"]) if row[f"q{i}"] is not None else None
    for i in large:
        found[names[i]] = _selected(data.select(F.col(f"v{i}").alias("v")), sizes[f"n{i}"], probs)
    return {n: found[n] for n in names}


def _selected(data: DataFrame, n: int, probs: Sequence[float]) -> list[float]:
    """Quantiles of one high-cardinality column by counting, not by sorting it all."""
    places = [(n - 1) * p for p in probs]
    ranks = sorted({math.floor(h) for h in places} | {math.ceil(h) for h in places})
    counts = data.where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n")).persist()
    try:
        distinct = counts.count()
        edges = range_edges(counts, ["v"], max(2, math.ceil(distinct / ROWS_PER_RANGE)), distinct)
        ranged = counts.withColumn(_B, range_by_order(["v"], edges).cast("int"))
        totals = sorted((r[_B], r["t"]) for r in ranged.groupBy(_B).agg(F.sum("n").alias("t")).collect())
        offset, needed = 0, {}
        for b, t in totals:
            if any(offset <= r < offset + t for r in ranks):
                needed[b] = offset
            offset += t
        starts = data.sparkSession.createDataFrame(list(needed.items()), f"{_B} int, {_O} bigint")
        before = F.coalesce(
            F.sum("n").over(W.partitionBy(_B).orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        )
        # Ranks and values meet on equal stretches of the rank axis: an equi-join.
        width = max(1, n // len(ranks))
        wanted = data.sparkSession.createDataFrame([(r, r // width) for r in ranks], "r bigint, stretch bigint")
        spans = (
            ranged.join(F.broadcast(starts), _B)  # a row per range of a million values
            .select("v", (F.col(_O) + before).alias("lo"), "n")
        )
        last = F.col("lo") + F.col("n") - 1
        placed = spans.withColumn(
            "stretch", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(last / width)))
        )
        hits = placed.join(F.broadcast(wanted), "stretch").where(  # two rows per probability
            (F.col("r") >= F.col("lo")) & (F.col("r") <= last)
        )
        at = {r["r"]: r["v"] for r in hits.select("r", "v").collect()}
    finally:
        counts.unpersist()
    values = []
    for h in places:
        low, high = math.floor(h), math.ceil(h)
        values.append(at[low] + (at[high] - at[low]) * (h - low))
    return values


def average_ranks(df: DataFrame, column: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per distinct value: (value, n, rank), ties sharing their mean rank."""
    counts = df.where(c(column).isNotNull()).groupBy(c(column).alias("value")).agg(F.count("*").alias("n"))
    placed = running_total(counts, ["value"], weight="n", rows_per_range=rows_per_range)
    return placed.select("value", "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))
