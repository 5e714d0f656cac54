"""Gradient boosted trees of all classes together, on histograms.

Features are binned once. A round grows one tree per class (one for two classes), all
from the same passes: a pass adds up gradients, curvatures and rows per node, feature and
bin of the nodes that are new, left ones only; right ones are their parents' rest. Missing
values have a bin of their own and go to the side where they gain more. Trees grow best leaf
first up to a number of leaves, level by level where only the depth bounds them.

A table of up to ``one_task`` rows is fitted by one task, where passes are array operations.
A larger one takes a job per pass: over blocks of arrays that stay with the executors, with one stage
and a part of the sums from each task, or, where those parts are too large for the driver, over a
written table with a keyed aggregate. Margins are renewed every few rounds. All add up the same numbers.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table
from tabloom.functions.rank import quantiles
from tabloom.functions.stats import class_index, one_row
from tabloom.session import cut_lineage

ONE_TASK = 100_000
#: Cuts of a feature at most (all midpoints where it has fewer values), and rounds between two rewrites of margins.
CUTS, CUT_EVERY = 255, 10
#: Tasks of a pass over blocks at most, bytes of sums that the driver takes from all of them, and rounds between two renewals of blocks.
TASKS, PASSED, RENEW_EVERY = 64, 64_000_000, 3


@dataclass(frozen=True)
class Plan:
    """How trees grow; ``leaves`` None leaves only the depth, ``depth`` None only the leaves."""

    rounds: int = 100
    rate: float = 0.1
    depth: int | None = 3
    leaves: int | None = None
    penalty: float = 0.0
    least_rows: int = 1
    least_curvature: float = 0.0

    @property
    def most_leaves(self) -> int:
        return self.leaves or 1 << self.depth


@dataclass
class Node:
    """A node of a growing tree with its sums; its split is the best one, whether it is used or not."""

    depth: int
    sums: np.ndarray
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    missing_left: bool = True
    left: int = -1
    right: int = -1
    used: bool = False


@dataclass
class Growing:
    nodes: list[Node] = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array([getattr(n, f) for n in self.nodes]) for f in ("feature", "bin", "missing_left", "left", "right"))


def route(arrays: tuple, bins: np.ndarray, missing: int) -> np.ndarray:
    """The node of each row of bins; nodes without children are ends."""
    feature, cut, missing_left, left, right = arrays
    node, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(live):
        at = node[live]
        inner = left[at] >= 0
        live, at = live[inner], at[inner]
        if len(live):
            b = bins[live, feature[at]]
            goes_left = np.where(b == missing, missing_left[at], b <= cut[at])
            node[live] = np.where(goes_left, left[at], right[at])
    return node


def slopes(margins: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the log loss, a column per tree of a round."""
    if k == 2:
        p = 1 / (1 + np.exp(-margins))
        return p - (y == 1)[:, None], p * (1 - p)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (y[:, None] == np.arange(k)), p * (1 - p) * k / (k - 1)


def histograms(growing: list, wanted: list[tuple[int, int]], bins: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """(node, feature, bin, 3): sums of gradients, curvatures and rows of the wanted (tree, node)."""
    p = bins.shape[1]
    out = np.zeros((len(wanted), p, width, 3))
    for tree in sorted({t for t, _ in wanted}):
        own = np.full(len(growing[tree][0]), -1)
        slots = [i for i, (t, _) in enumerate(wanted) if t == tree]
        for place, i in enumerate(slots):
            own[wanted[i][1]] = place
        slot = own[route(growing[tree], bins, width - 1)]
        rows = np.flatnonzero(slot >= 0)
        base, size = slot[rows] * width, len(slots) * width
        for f in range(p):
            cell = base + bins[rows, f]
            for j, weight in enumerate((g[rows, tree], h[rows, tree], None)):
                out[slots, f, :, j] = np.bincount(cell, weights=weight, minlength=size).reshape(len(slots), width)
    return out


class Boosting:
    """The rounds of a fit over ``source``, which has ``sums(growing, wanted)`` and ``add(trees)``."""

    def __init__(self, source, plan: Plan, counts: np.ndarray, cuts: list[int], width: int) -> None:
        self.source, self.plan, self.cuts, self.width = source, plan, cuts, width
        share = counts / counts.sum()
        self.base = [float(np.log(share[1] / share[0]))] if len(counts) == 2 else np.log(share).tolist()

    def run(self) -> dict:
        rounds = []
        for _ in range(self.plan.rounds):
            trees = self._round()
            if all(len(t["feature"]) == 1 and t["value"][0] == 0 for t in trees):
                break
            rounds.append(trees)
            self.source.add(trees)
        return {"base": self.base, "rounds": rounds}

    def _round(self) -> list[dict]:
        trees = [Growing([Node(0, np.zeros(0))]) for _ in self.base]
        tables: dict[tuple[int, int], np.ndarray] = {}
        roots = [(t, 0) for t in range(len(trees))]
        for place, table in zip(roots, self.source.sums([t.arrays() for t in trees], roots), strict=True):
            self._known(trees, place, table, tables)
        while True:
            asked = [(t, n) for t, tree in enumerate(trees) for n in self._choose(tree)]
            if not asked:
                return [self._built(tree) for tree in trees]
            lefts = []
            for t, n in asked:
                tree, node = trees[t], trees[t].nodes[n]
                node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
                tree.nodes += [Node(node.depth + 1, np.zeros(0)), Node(node.depth + 1, np.zeros(0))]
                lefts.append((t, node.left))
            found = self.source.sums([t.arrays() for t in trees], lefts)
            for (t, n), left, table in zip(asked, lefts, found, strict=True):
                self._known(trees, left, table, tables)
                self._known(trees, (t, trees[t].nodes[n].right), tables.pop((t, n)) - table, tables)

    def _choose(self, tree: Growing) -> list[int]:
        """Mark the splits of the best leaves; return leaves whose children are to be known first, none if the tree is done."""
        for node in tree.nodes:
            node.used = False
        queue = [(-tree.nodes[0].gain, 0)] if tree.nodes[0].gain > 0 else []
        leaves = 1
        while queue and leaves < self.plan.most_leaves:
            _, n = queue[0]
            node = tree.nodes[n]
            if node.left < 0:
                # all in the queue that may still be split, best first: their children come from one pass
                return [i for _, i in sorted(queue)[: self.plan.most_leaves - leaves] if tree.nodes[i].left < 0]
            heapq.heappop(queue)
            node.used, leaves = True, leaves + 1
            for child in (node.left, node.right):
                if tree.nodes[child].gain > 0:
                    heapq.heappush(queue, (-tree.nodes[child].gain, child))
        return []

    def _known(self, trees: list[Growing], place: tuple[int, int], table: np.ndarray, tables: dict) -> None:
        """Take in a node's histogram: its sums and its best split."""
        plan, node = self.plan, trees[place[0]].nodes[place[1]]
        node.sums = table[0].sum(axis=0)
        g, h, n = node.sums
        if (plan.depth is not None and node.depth >= plan.depth) or n < 2 * plan.least_rows:
            return
        tables[place] = table
        whole = g * g / (h + plan.penalty) if h + plan.penalty > 0 else 0.0
        best = 1e-12 * max(1.0, abs(whole))
        running = np.cumsum(table[:, :-1], axis=1)
        for f in range(len(table)):
            if not self.cuts[f]:
                continue
            left = running[f, : self.cuts[f]]
            gap = table[f, -1]
            for missing_left in (True, False) if gap[2] > 0 else (True,):
                side = left + gap if missing_left else left
                other = node.sums - side
                room = (np.minimum(side[:, 2], other[:, 2]) >= max(1, plan.least_rows) - 1e-9) & (
                    np.minimum(side[:, 1], other[:, 1]) >= plan.least_curvature)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = side[:, 0] ** 2 / (side[:, 1] + plan.penalty) + other[:, 0] ** 2 / (other[:, 1] + plan.penalty) - whole
                gain = np.where(room & np.isfinite(gain), gain, -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best = node.gain = float(gain[i])
                    node.feature, node.bin, node.missing_left = f, i, missing_left

    def _built(self, tree: Growing) -> dict:
        """The used splits as lists; leaves carry their step."""
        out = {k: [] for k in ("feature", "bin", "missing_left", "left", "right", "value")}

        def add(n: int) -> int:
            node, at = tree.nodes[n], len(out["feature"])
            g, h, _ = node.sums
            step = -self.plan.rate * g / (h + self.plan.penalty) if h + self.plan.penalty > 0 else 0.0
            row = (node.feature, node.bin, node.missing_left, -1, -1, 0.0) if node.used else (-1, -1, True, -1, -1, float(step))
            for name, v in zip(out, row, strict=True):
                out[name].append(v)
            if node.used:
                out["left"][at] = add(node.left)
                out["right"][at] = add(node.right)
            return at

        add(0)
        return out


def steps_of(trees: list[dict], bins: np.ndarray, missing: int) -> np.ndarray:
    """What a round adds to the margins of each row."""
    out = np.empty((len(bins), len(trees)))
    for k, t in enumerate(trees):
        arrays = tuple(np.array(t[f]) for f in ("feature", "bin", "missing_left", "left", "right"))
        out[:, k] = np.array(t["value"])[route(arrays, bins, missing)]
    return out


class InTask:
    """All rows in one task."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, k: int, base: list[float], width: int) -> None:
        self.bins, self.y, self.k, self.width = bins, y, k, width
        self.margins = np.tile(np.array(base), (len(y), 1))
        self.slopes = slopes(self.margins, y, k)

    def sums(self, growing: list, wanted: list) -> np.ndarray:
        return histograms(growing, wanted, self.bins, *self.slopes, self.width)

    def add(self, trees: list[dict]) -> None:
        self.margins += steps_of(trees, self.bins, self.width - 1)
        self.slopes = slopes(self.margins, self.y, self.k)


class OnBlocks:
    """Rows as blocks of arrays (bins, y, margins) that stay with the executors; a call of ``sums`` is a job of one stage."""

    def __init__(self, blocks: RDD, k: int, width: int) -> None:
        self.k, self.width, self.pending = k, width, []
        self.blocks, self.before = blocks.persist(StorageLevel.MEMORY_AND_DISK), None

    def _current(self):
        width, pending = self.width, list(self.pending)

        def current(blocks: Iterator[tuple]) -> Iterator[tuple]:
            for bins, y, margins in blocks:
                for new in pending:
                    margins = margins + steps_of(new, bins, width - 1)
                yield bins, y, margins

        return current

    def sums(self, growing: list, wanted: list) -> np.ndarray:
        current, k, width = self._current(), self.k, self.width

        def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
            total = None
            for bins, y, margins in current(blocks):
                own = histograms(growing, wanted, bins, *slopes(margins, y, k), width)
                total = own if total is None else total + own
            if total is not None:
                flat = total.reshape(-1, 3)
                cells = np.flatnonzero(flat[:, 2])
                yield total.shape, cells, flat[cells]

        out = None
        for shape, cells, part in self.blocks.mapPartitions(run).collect():  # in the order of the partitions
            out = np.zeros((int(np.prod(shape[:3])), 3)) if out is None else out
            out[cells] += part
        if self.before is not None:  # the blocks in use have been made now
            self.before.unpersist()
            self.before = None
        return out.reshape(shape)

    def add(self, trees: list[dict]) -> None:
        self.pending.append(trees)
        if len(self.pending) >= RENEW_EVERY:
            self.before, self.blocks = self.blocks, self.blocks.mapPartitions(self._current()).persist(StorageLevel.MEMORY_AND_DISK)
            self.pending = []

    def close(self) -> None:
        for blocks in (self.before, self.blocks):
            if blocks is not None:
                blocks.unpersist()


class OnSpark:
    """Rows (bins, y, margins as binary) in a written table; each call of ``sums`` is a job."""

    def __init__(self, rows: DataFrame, p: int, k: int, base: list[float], width: int) -> None:
        self.p, self.k, self.width, self.base = p, k, width, base
        self.rows, self.pending = rows.withColumn("margins", F.lit(np.array(base).tobytes())), []

    def _margins(self):
        p, trees, width, pending = self.p, len(self.base), self.width, list(self.pending)

        def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint16).reshape(-1, p)
            margins = np.frombuffer(b"".join(batch.column("margins").to_pylist()), np.float64).reshape(-1, trees).copy()
            for new in pending:
                margins += steps_of(new, bins, width - 1)
            return bins, batch.column("y").to_numpy(), margins

        return read

    def sums(self, growing: list, wanted: list) -> np.ndarray:
        read, k, width, shape = self._margins(), self.k, self.width, (len(wanted), self.p, self.width, 3)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                bins, y, margins = read(batch)
                total += histograms(growing, wanted, bins, *slopes(margins, y, k), width)
            flat = total.reshape(-1, 3)
            cells = np.flatnonzero(flat[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(flat[cells, j]) for j in range(3))], ["cell", "g", "h", "n"])

        parts = self.rows.mapInArrow(run, "cell long, g double, h double, n double")
        found = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        out = np.zeros((int(np.prod(shape[:3])), 3))
        out[found.column("cell").to_numpy()] = np.stack([found.column(c).to_numpy() for c in "ghn"], axis=1)
        return out.reshape(shape)

    def add(self, trees: list[dict]) -> None:
        self.pending.append(trees)
        if len(self.pending) < CUT_EVERY:
            return
        read = self._margins()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, margins = read(batch)
                yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), pa.array([m.tobytes() for m in margins], pa.binary())], ["bins", "y", "margins"])

        self.rows, self.pending = cut_lineage(self.rows.mapInArrow(run, "bins binary, y int, margins binary")), []


def cuts_of(rows: DataFrame, p: int, most: int = CUTS) -> list[list[float]]:
    """Midpoints of all values where a feature has few, else quantiles."""
    x = {f: F.get("x", F.lit(f)) for f in range(p)}
    about = one_row(rows, {str(f): F.approx_count_distinct(v) for f, v in x.items()})
    few = [f for f in range(p) if about[str(f)] <= most]
    found: list[list[float]] = [[] for _ in range(p)]
    for f, values in one_row(rows, {str(f): F.sort_array(F.collect_set(x[f])) for f in few}).items():  # a few hundred values
        v = np.array(values, float)
        found[int(f)] = (v[:-1] + (v[1:] - v[:-1]) / 2).tolist()
    many = {str(f): x[f] for f in range(p) if f not in few}
    if many:
        for f, values in quantiles(rows, many, [i / (most + 1) for i in range(1, most + 1)]).items():
            found[int(f)] = sorted(set(values or []))
    return found


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bins of a matrix: how many cuts are below a value; missing values have the last one."""
    missing = max(map(len, cuts), default=0) + 1
    out = np.empty(x.shape, np.uint16)
    for f, own in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), missing, np.searchsorted(np.array(own), x[:, f], side="left"))
    return out


def fit_boosting(t: Table, labels: list, plan: Plan, one_task: int = ONE_TASK) -> dict:
    """The state of a fit: labels, cuts, base margins and the trees of each round, as plain lists."""
    p, k = len(t.features), len(labels)
    rows = t.df.select(F.array(*[t.number(n) for n in t.features]).alias("x"), class_index(t, labels).cast("int").alias("y"))
    rows = cut_lineage(rows.where("y IS NOT NULL"))
    counts = np.zeros(k, np.int64)
    for r in rows.groupBy("y").count().collect():
        counts[r.y] = r["count"]
    cuts = cuts_of(rows, p)
    if k < 2:
        return {"labels": labels, "cuts": cuts, "base": [0.0] * k, "rounds": []}
    width = max(map(len, cuts)) + 2
    lengths = [len(v) for v in cuts]

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return binned(batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p), cuts)

    tasks = max(1, min(TASKS, t.df.sparkSession.sparkContext.defaultParallelism))
    if counts.sum() <= one_task:

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(matrix(b), b.column("y").to_numpy()) for b in batches if b.num_rows]
            bins, y = (np.concatenate(v) for v in zip(*held, strict=True))
            found = Boosting(None, plan, counts, lengths, width)
            found.source = InTask(bins, y, k, found.base, width)
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(found.run())])], ["model"])

        model = json.loads(rows.repartition(1).mapInArrow(fit, "model string").first().model)
    elif tasks * (1 if k == 2 else k) * max(1, plan.most_leaves // 2) * p * width * 32 <= PASSED:

        def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([matrix(b).tobytes()]), pa.array([b.column("y").to_numpy().astype(np.int32).tobytes()])], ["bins", "y"])

        found = Boosting(None, plan, counts, lengths, width)
        base = np.array(found.base)

        def arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            y = np.frombuffer(r.y, np.int32)
            return np.frombuffer(r.bins, np.uint16).reshape(-1, p), y, np.tile(base, (len(y), 1))

        found.source = OnBlocks(rows.repartition(tasks).mapInArrow(blocked, "bins binary, y binary").rdd.map(arrays), k, width)
        try:
            model = found.run()
        finally:
            found.source.close()
    else:

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in matrix(b)], pa.binary()), b.column("y")], ["bins", "y"])

        found = Boosting(None, plan, counts, lengths, width)
        found.source = OnSpark(cut_lineage(rows.mapInArrow(coded, "bins binary, y int")), p, k, found.base, width)
        model = found.run()
    return {"labels": labels, "cuts": cuts, **model}


def boosted_shares(state: dict, features: list[Column]) -> Column:
    """Class probabilities of each row, in Arrow batches."""
    cuts, base, rounds, k = state["cuts"], state["base"], state["rounds"], len(state["labels"])
    p, missing = len(features), max(map(len, cuts), default=0) + 1

    @F.pandas_udf("array<double>")
    def scored(x: pd.Series) -> pd.Series:
        bins = binned(np.array(x.tolist(), float).reshape(-1, p), cuts)
        margins = np.tile(np.array(base), (len(bins), 1))
        for trees in rounds:
            margins += steps_of(trees, bins, missing)
        if k == 2:
            high = 1 / (1 + np.exp(-margins[:, 0]))
            return pd.Series(list(np.stack([1 - high, high], axis=1)))
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

    return scored(F.array(*features))
