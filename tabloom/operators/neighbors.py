"""Exact k nearest neighbours by pivots (Lu et al. 2012, nearest neighbour joins).

Training rows belong to the cell of their nearest pivot. For a query row the
triangle inequality gives an upper bound on its k-th distance from the pivots
alone, and only cells that can hold something nearer receive the row. Cells
that lie side by side are packed into units of bounded size (a crowded cell is split
into several), and a query row goes once to each unit it needs, not once to each
cell. Units and the rows that visit them meet slice by slice, so a task is bounded however
the rows are spread; in it, cells out of reach are skipped, and it hands on at most k rows
per query row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tabloom.frame import Table, c
from tabloom.functions.keys import keyed_hash
from tabloom.functions.stats import classes
from tabloom.operators.base import register
from tabloom.operators.learner import Classifier

#: Query rows that are compared at a time, at most.
BLOCK_ROWS = 20_000
ROWS_PER_PIVOT = 5_000
MAX_PIVOTS = 1024
#: Rows and bytes of a unit, and of a slice of its visitors.
UNIT_ROWS, UNIT_BYTES = 20_000, 16_000_000
#: Distances, and coordinates of differences, that a task holds at once.
HELD = 4_000_000
# Slack on float bounds, relative to the distances involved.
SLACK = 1e-9


def _vectors(column: pa.ChunkedArray | pa.Array, p: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def _squares(x: np.ndarray, norms: np.ndarray, others: np.ndarray, other_norms: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding relative to the norms."""
    out = x @ others.T
    out *= -2
    out += norms[:, None]
    out += other_norms[None, :]
    return out


class _Pivots:
    """Bounds on the distances to the pivots that hold in spite of rounding."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.norms = x, (x * x).sum(axis=1)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = (x * x).sum(axis=1)
        d2 = _squares(x, norms, self.x, self.norms)
        gap = 1e-12 * (norms[:, None] + self.norms[None, :])
        return np.sqrt(np.maximum(d2 - gap, 0)), np.sqrt(np.maximum(d2, 0) + gap)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A near pivot of each row, and the exact distance to it."""
        cell = np.empty(len(x), np.int64)
        step = max(1, HELD // len(self.x))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            cell[at : at + step] = _squares(part, np.zeros(len(part)), self.x, self.norms).argmin(axis=1)
        return cell, np.sqrt(((x - self.x[cell]) ** 2).sum(axis=1))


def _sides(train: Table, test: Table) -> tuple[DataFrame, DataFrame]:
    """(tkey, y, h, x) and (qkey, h, x) with keys as structs."""
    def side(t: Table, key_name: str, extra):
        x = F.array(*[t.number(n) for n in t.features]).alias("x")
        return t.df.select(
            F.struct(*[c(k) for k in t.key]).alias(key_name), keyed_hash(t.df, t.key, 7).alias("h"), *extra, x
        )

    return side(train, "tkey", [c(train.label).alias("y")]), side(test, "qkey", [])


def nearest(train: Table, test: Table, k: int, block_rows: int = BLOCK_ROWS, rows_per_pivot: int = ROWS_PER_PIVOT) -> DataFrame:
    """(qkey, rank 1..k, d2, y): the k nearest training rows of every test row.

    Ties in distance go to the smaller training key. A training row with a missing value is nobody's neighbour, a
    test row with one is an error.
    """
    left, right = _sides(train, test)
    left = left.where(~F.exists("x", lambda v: v.isNull()))
    n, p = left.count(), len(train.features)
    want = max(1, min(MAX_PIVOTS, n // rows_per_pivot))
    drawn = left.orderBy("h", "tkey").select("x").limit(want).collect()  # MAX_PIVOTS rows
    found = np.unique(np.array([r["x"] for r in drawn], dtype=float).reshape(-1, p), axis=0) if drawn else np.zeros((1, p))
    pivots = _Pivots(_side_by_side(found))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = pivots.cells(_vectors(batch.column("x"), p))
            yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column("d", pa.array(d))

    placed = left.mapInArrow(assign, T.StructType([*left.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())]))
    sizes, radius, near = _cell_summary(placed, len(pivots.x), k)
    unit_rows = max(1, min(UNIT_ROWS, UNIT_BYTES // (8 * p)))
    first, pieces = _units(sizes, unit_rows)
    units = int((first + pieces).max())
    visiting = _visitors(right, pivots, radius, near, first, pieces, units, k)
    loads = dict(visiting.groupBy("unit").agg(F.count("*").alias("n")).toLocalIterator())  # a row per unit

    spark = left.sparkSession
    slices = spark.createDataFrame([(u, math.ceil(m / unit_rows)) for u, m in loads.items()], "unit int, slices int")
    cells = spark.createDataFrame([(j, int(first[j]), int(pieces[j])) for j in range(len(first)) if pieces[j]], "cell int, first int, pieces int")
    # both have a row per cell or unit; units without visitors are left out
    housed = placed.join(F.broadcast(cells), "cell").withColumn("unit", (F.col("first") + F.pmod("h", "pieces")).cast("int"))
    t_side = (
        housed.join(F.broadcast(slices), "unit")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("unit", "slice", "tkey", "y", "cell", "x")
    )
    q_side = visiting.join(F.broadcast(slices), "unit").select("unit", F.pmod("h", "slices").cast("int").alias("slice"), "qkey", "worst", "x")
    out_schema = T.StructType(
        [
            T.StructField("qkey", right.schema["qkey"].dataType),
            T.StructField("tkey", left.schema["tkey"].dataType),
            T.StructField("y", left.schema["y"].dataType),
            T.StructField("d2", T.DoubleType()),
        ]
    )

    def compare(t: pa.Table, q: pa.Table) -> pa.Table:
        if not t.num_rows or not q.num_rows:
            empty = [q.column("qkey").slice(0, 0), t.column("tkey").slice(0, 0), t.column("y").slice(0, 0), pa.array([], pa.float64())]
            return pa.table(empty, names=out_schema.names)
        keys = t.column("tkey").combine_chunks()
        named = pa.table(keys.flatten(), names=[str(i) for i in range(keys.type.num_fields)])
        t = t.take(pc.sort_indices(named, [(i, "ascending") for i in named.column_names], null_placement="at_start"))
        tx, qx = _vectors(t.column("x"), p), _vectors(q.column("x"), p)
        rows, places, dist = _nearest_in(tx, t.column("cell").to_numpy(), qx, q.column("worst").to_numpy(), pivots, radius, k, block_rows)
        return pa.table([q.column("qkey").take(pa.array(rows)), t.column("tkey").take(pa.array(places)), t.column("y").take(pa.array(places)), pa.array(dist)], names=out_schema.names)

    at = ["unit", "slice"]
    found = t_side.groupBy(*at).cogroup(q_side.groupBy(*at)).applyInArrow(compare, out_schema)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("qkey").orderBy("d2", "tkey")))
    return ranked.where(F.col("rank") <= k).select("qkey", "rank", "d2", "y")


def _side_by_side(pivots: np.ndarray) -> np.ndarray:
    """Pivots in the order of their leading axis, so that cells with close numbers lie close."""
    centred = pivots - pivots.mean(axis=0)
    return pivots[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]


def _units(sizes: dict[int, int], unit_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first unit of each cell and how many it has; small cells share one, empty ones (none) have 0."""
    cells = max(sizes, default=0) + 1
    first, pieces, unit, held = np.zeros(cells, np.int64), np.zeros(cells, np.int64), 0, 0
    for cell in sorted(sizes):
        if held and held + sizes[cell] > unit_rows:
            unit, held = unit + 1, 0
        first[cell], pieces[cell] = unit, -(-sizes[cell] // unit_rows)
        unit, held = (unit, held + sizes[cell]) if pieces[cell] == 1 else (unit + pieces[cell], 0)
    return first, pieces


def _nearest_in(tx: np.ndarray, cell: np.ndarray, qx: np.ndarray, worst: np.ndarray, pivots: _Pivots, radius: np.ndarray, k: int, block_rows: int):
    """Query rows, places of their k nearest rows of ``tx`` (ties: the first ones), squared distances."""
    there, of = np.unique(cell, return_inverse=True)
    own = _Pivots(pivots.x[there])
    norms = (tx * tx).sum(axis=1)
    step = max(1, min(256, block_rows, HELD // len(tx)))
    order = np.argsort(own.cells(qx)[0], kind="stable")  # rows of a block ask for the same cells
    out = []
    for start in range(0, len(qx), step):
        mine = order[start : start + step]
        part = qx[mine]
        asked = (own.bounds(part)[0] - radius[there][None, :] <= worst[mine][:, None]).any(axis=0)
        sub = np.flatnonzero(asked[of])
        if not len(sub):
            continue
        x, held = (tx, norms) if len(sub) == len(tx) else (tx[sub], norms[sub])
        squares = (part * part).sum(axis=1)
        rough = _squares(part, squares, x, held)
        take = min(k, len(sub))
        kth = np.partition(rough, take - 1, axis=1)[:, take - 1] + SLACK * (held.max() + squares + 1)
        near = rough <= kth[:, None]
        counts = near.sum(axis=1)
        done = 0
        while done < len(part):  # rows whose candidates are few enough together; one row has at most a unit
            last = max(done + 1, int(np.searchsorted(np.cumsum(counts[done:]), HELD // max(1, tx.shape[1]), side="right")) + done)
            rows, places = np.nonzero(near[done:last])
            exact = ((x[places] - part[rows + done]) ** 2).sum(axis=1)
            best = np.lexsort((places, exact, rows))
            starts = np.concatenate([[0], np.cumsum(counts[done:last])[:-1]])
            best = best[(starts[:, None] + np.arange(take)).ravel()]
            out.append((mine[rows[best] + done], sub[places[best]], exact[best]))
            done = last
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _cell_summary(placed: DataFrame, cells: int, k: int):
    """Rows, radius and k smallest pivot distances per cell from per-task partials."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius, near = {}, {}, {}
        for batch in batches:
            of, d = batch.column("cell").to_numpy(), batch.column("d").to_numpy()
            order = np.lexsort((d, of))
            of, d = of[order], d[order]
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            for cell, v in zip(of[cuts].tolist(), np.split(d, cuts[1:]), strict=False):
                n[cell] = n.get(cell, 0) + len(v)
                radius[cell] = max(radius.get(cell, 0.0), float(v[-1]))
                near[cell] = np.sort(np.concatenate([near.get(cell, np.empty(0)), v[:k]]))[:k]
        columns = [pa.array(n.keys(), pa.int32()), pa.array(n.values(), pa.int64()), pa.array(radius.values(), pa.float64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(near.values()), pa.list_(pa.float64()))], ["cell", "n", "radius", "near"])

    parts = placed.select("cell", "d").mapInArrow(partial, "cell int, n bigint, radius double, near array<double>").persist()
    try:
        heads = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
        rank = F.row_number().over(W.partitionBy("cell").orderBy("v"))
        lows = parts.select("cell", F.explode("near").alias("v")).withColumn("r", rank).where(F.col("r") <= k).collect()
    finally:
        parts.unpersist()
    sizes = {r["cell"]: r["n"] for r in heads}
    radius = np.full(cells, -np.inf)
    near = np.full((cells, k), np.inf)
    for r in heads:
        radius[r["cell"]] = r["radius"]
    for r in lows:
        near[r["cell"], r["r"] - 1] = r["v"]
    return sizes, radius, near


def _visitors(right: DataFrame, pivots: _Pivots, radius: np.ndarray, near: np.ndarray, first: np.ndarray, pieces: np.ndarray, units: int, k: int) -> DataFrame:
    """The query rows, once for each unit with a cell in reach, with ``worst``, a bound on the k-th distance."""
    schema = T.StructType([*right.schema.fields, T.StructField("worst", T.DoubleType()), T.StructField("unit", T.IntegerType())])
    own = np.flatnonzero(pieces)
    cell_of, unit_of = np.repeat(own, pieces[own]), np.concatenate([first[j] + np.arange(pieces[j]) for j in own] or [np.zeros(0, np.int64)])
    starts = np.flatnonzero(np.diff(unit_of, prepend=-1))
    p = pivots.x.shape[1]
    step = max(1, min(256, HELD // near.size, HELD // (p * max(1, units))))

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if units else 0, step):
                batch = whole.slice(at, step)
                x = _vectors(batch.column("x"), p)
                if np.isnan(x).any():
                    raise ValueError("a row with a missing value has no nearest neighbours")
                low, high = pivots.bounds(x)
                worst = np.partition((high[:, :, None] + near[None, :, :]).reshape(len(x), -1), k - 1, axis=1)[:, k - 1]
                worst = worst * (1 + SLACK) + SLACK
                reach = low - radius[None, :] <= worst[:, None]
                rows, hit = np.nonzero(np.logical_or.reduceat(reach[:, cell_of], starts, axis=1))
                sent = batch.take(pa.array(rows))
                yield sent.append_column("worst", pa.array(worst[rows])).append_column("unit", pa.array(unit_of[starts[hit]], pa.int32()))

    return right.mapInArrow(spread_out, schema)


@register
class KNeighbors(Classifier):
    """k = 5, Euclidean, uniform votes; the smaller label wins a tie.

    The fitted state is the training table itself, kept as a lazy frame.
    """

    name = "clf_knn"
    title = "KNeighborsClassifierPrim"

    def learn(self, t):
        return {"train": t, "labels": classes(t)}

    def apply(self, t, state):
        k = self.params.get("k", 5)
        settings = {n: self.params[n] for n in ("block_rows", "rows_per_pivot") if n in self.params}
        found = nearest(state["train"], t, k, **settings)
        labels = state["labels"]
        shares = [F.avg((F.col("y") == F.lit(v)).cast("double")).alias(f"p{i}") for i, v in enumerate(labels)]
        votes = found.groupBy("qkey").agg(*shares)
        keyed = t.df.withColumn("qkey", F.struct(*[c(n) for n in t.key]))
        joined = keyed.join(votes, "qkey")
        return self.outputs(t.with_df(joined), labels, [F.col(f"p{i}") for i in range(len(labels))])
