"""Mutual information by nearest neighbours in one dimension (Ross 2014), without all pairs.

For a row of class y, r is the distance to its k-th neighbour within the class and m the
number of rows of any class nearer than r, itself included. The estimate is
psi(N) + mean psi(k) - mean psi(N_y) - mean psi(m). Values that repeat need no added noise: where k
other rows of the class have the row's own value, r is 0, m counts the rows of that value and k is the
number of those in the class (Gao et al. 2017).

Rows become cells (feature, class, value, count) first. Cells are cut into ranges of
(feature, class, value); a range gets the nearest k cells on either side of it, so that
ordinary windows inside ranges see all neighbours. The counts m are differences of two prefix
sums over (feature, value), which are range-cut as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabloom.frame import Table, c
from tabloom.functions.rank import ONE_RANGE, ROWS_PER_RANGE, range_by_order, range_edges, running_total
from tabloom.functions.stats import class_index, classes
from tabloom.session import cut_lineage

EULER = 0.57721566490153286
#: Arguments below this are looked up, others go through the asymptotic series (error under 1e-15).
SERIES_FROM = 32
ORDER = ("f", "y", "x")


def digamma(m: Column) -> Column:
    """psi of a whole number of at least 1."""
    table = [-EULER + math.fsum(1 / k for k in range(1, i)) for i in range(1, SERIES_FROM)]
    v = m.cast("double")
    v2 = v * v
    series = F.log(v) - 0.5 / v - (1 / 12 - (1 / 120 - 1 / (252 * v2)) / v2) / v2
    return F.when(m < SERIES_FROM, F.get(F.array(*[F.lit(p) for p in table]), (m - 1).cast("int"))).otherwise(series)


def value_cells(t: Table, labels: list) -> DataFrame:
    """f, y int, x double, n, held long: how often each value occurs in a class, and the rows of feature and class.

    Classes of one row are left out. Nulls are left out feature by feature.
    """
    long = t.df.select(class_index(t, labels).cast("int").alias("y"), F.posexplode(F.array(*[t.number(n) for n in t.features])).alias("f", "x"))
    cells = long.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*ORDER).agg(F.count("*").alias("n"))
    cells = cut_lineage(cells)
    held = cells.groupBy("f", "y").agg(F.sum("n").alias("held")).where("held > 1")
    return cells.join(F.broadcast(held), ["f", "y"])  # features times classes rows


def _halo(rows: list, k: int) -> list[tuple]:
    """Cells that a range lacks: up to k of the class of its first cell before it, and of its last one after it.

    ``rows`` has (range, first k cells, last k cells) in order.
    """
    out = []
    for i, (r, first, last) in enumerate(rows):
        for own, others, side in ((first[0], [x[2][::-1] for x in rows[:i]][::-1], "before"), (last[-1], [x[1] for x in rows[i + 1 :]], "after")):
            found: list = []
            for cells in others:
                found += [v for v in cells if tuple(v)[:2] == tuple(own)[:2]]
                if len(found) >= k or len(cells) == 0 or tuple(cells[-1])[:2] != tuple(own)[:2]:
                    break
            out += [(r, v.f, v.y, v.x, v.n) for v in found[:k]]
    return out


def with_neighbours(cells: DataFrame, k: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``cells`` with ``near``: array of (x, n) of up to k cells on either side within feature and class."""
    rows = cells.count()
    ranges = math.ceil(rows / rows_per_range)
    if rows > ONE_RANGE:
        ranges = max(ranges, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = range_edges(cells, ORDER, ranges, rows)
    ranged = cells.withColumn("r", range_by_order(ORDER, edges).cast("int")).withColumn("own", F.lit(True))
    if edges:
        cell = F.struct(*ORDER, "n")
        ends = None
        for name, order in (("first", [F.asc(o) for o in ORDER]), ("last", [F.desc(o) for o in ORDER])):
            near = ranged.withColumn("at", F.row_number().over(W.partitionBy("r").orderBy(*order))).where(F.col("at") <= k)
            part = near.groupBy("r").agg(F.array_sort(F.collect_list(cell)).alias(name))
            ends = part if ends is None else ends.join(part, "r")
        # 2 k cells for each range of a million
        halo = _halo([tuple(e) for e in ends.orderBy("r").collect()], k)
        if halo:
            extra = cells.sparkSession.createDataFrame(halo, "r int, f int, y int, x double, n bigint")
            ranged = ranged.unionByName(extra.withColumn("own", F.lit(False)), allowMissingColumns=True)
    order = W.partitionBy("r", "f", "y").orderBy("x")
    near = F.array(*[g(F.struct("x", "n"), i).over(order) for i in range(1, k + 1) for g in (F.lag, F.lead)])
    return ranged.select("*", F.filter(near, lambda v: v.isNotNull()).alias("near")).where("own").drop("own", "r")


def radius(k: int) -> Column:
    """Distance to the k-th other row of the class, k at most the rows there are."""
    need = F.least(F.lit(k), F.col("held") - 1) - (F.col("n") - 1)
    steps = F.array_sort(F.transform("near", lambda v: F.struct(F.abs(v["x"] - F.col("x")).alias("d"), v["n"].alias("n"))))
    start = F.struct(need.cast("long").alias("need"), F.lit(0.0).alias("r"))
    found = F.aggregate(
        steps, start, lambda acc, v: F.when(acc["need"] > 0, F.struct((acc["need"] - v["n"]).alias("need"), v["d"].alias("r"))).otherwise(acc)
    )
    return found["r"]


def counts_within(cells: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``cells`` (f, y, x, n, held, r) with ``m``: rows of the feature nearer than r, or of the same value where r is 0."""
    points = cells.groupBy("f", F.col("x").alias("v")).agg(F.sum("n").alias("w")).select("f", "v", F.lit(1).alias("side"), "w", F.lit(None).cast("struct<y:int,x:double,n:bigint,held:bigint,k:bigint,sign:int>").alias("cell"))
    # side 0 is before the points of its value, side 2 behind them; from the lower end up to the higher one
    open_, here = F.col("r") > 0, F.col("r") <= 0
    ends = F.array(
        F.struct((F.col("x") - F.col("r")).alias("v"), F.when(here, 0).otherwise(2).alias("side"), F.lit(-1).alias("sign")),
        F.struct((F.col("x") + F.col("r")).alias("v"), F.when(open_, 0).otherwise(2).alias("side"), F.lit(1).alias("sign")),
    )
    asked = cells.select("f", "y", "x", "n", "held", "k", F.explode(ends).alias("e")).select(
        "f", "e.v", "e.side", F.lit(0).cast("long").alias("w"), F.struct("y", "x", "n", "held", "k", "e.sign").alias("cell")
    )
    events = cut_lineage(points.unionByName(asked))
    placed = running_total(events, ["v", "side"], ["f"], "w", "before", rows_per_range=rows_per_range).where("cell IS NOT NULL")
    return placed.groupBy("f", "cell.y", "cell.x", "cell.n", "cell.held", "cell.k").agg(F.sum(F.col("cell.sign") * F.col("before")).alias("m"))


def neighbour_information(t: Table, neighbours: int = 3, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """feature, score, p_value (null): mutual information with the classes, at least 0.

    The label is a class; nulls of a feature and rows without class take no part. A
    feature without values has a null score.
    """
    labels = classes(t)
    cells = with_neighbours(value_cells(t, labels), neighbours, rows_per_range).withColumn("r", radius(neighbours)).drop("near")
    tied = F.col("r") <= 0
    cells = cells.withColumn("k", F.when(tied, F.col("n")).otherwise(F.least(F.lit(neighbours), F.col("held") - 1)).cast("long"))
    counted = counts_within(cut_lineage(cells), rows_per_range)
    terms = counted.groupBy("f").agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * (digamma(F.col("k")) - digamma(F.col("held")) - digamma(F.col("m")))).alias("terms"),
    )
    score = F.when(F.col("rows").isNotNull(), F.greatest(digamma(F.col("rows")) + F.col("terms") / F.col("rows"), F.lit(0.0)))
    names = t.df.sparkSession.createDataFrame(list(enumerate(t.features)), "i int, feature string")
    return names.join(terms, F.col("i") == F.col("f"), "left").select("feature", score.alias("score"), F.lit(None).cast("double").alias("p_value"))
