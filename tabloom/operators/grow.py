"""Trees grown from per-partition arrays: large nodes level by level, small ones whole in a task.

Rows are written once as (x array, y class, w counts per tree). A level of large nodes takes one or
two passes: a task routes its rows through the trees so far, adds up arrays per node and
feature, and hands over one row per cell; nothing is exploded. Once a node holds at most
``local_rows`` rows, its rows go to one task, which grows the rest of the subtree.
What a node draws depends on seed, tree and its place only, so any partitioning
gives the same trees.

Subtrees are written to the shared folder. A forest of few nodes is put together on the driver; of a
larger one it keeps the tops, and rows are scored where the subtrees are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.rank import quantiles
from tabloom.session import cut_lineage, kept_copy

LOCAL_ROWS = 20_000
#: Cells of arrays that a pass holds in a task, and quantile cuts of a feature where nodes are large.
CELLS, CUTS = 2_000_000, 31
#: Nodes times (classes + 4) of a forest that is put together on the driver: some 100 MB there.
HELD_CELLS = 2_000_000
#: Bytes of subtrees, and of rows, that meet in a task to be scored.
CHUNK_BYTES, SLICE_BYTES = 48_000_000, 32_000_000
#: A subtree: its nodes in parallel arrays.
PIECE = "slot long, nodes long, feature binary, cut binary, left binary, right binary, value binary"
KINDS = {"feature": np.int32, "cut": np.float64, "left": np.int32, "right": np.int32, "value": np.float32}


@dataclass
class Tree:
    """Nodes in parallel lists; feature -1 is a leaf; rows go right where x > cut. ``path`` numbers the place (root 1)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[list[float]] = field(default_factory=lambda: [[]])

    def split(self, node: int, feature: int, cut: float, counts: tuple) -> tuple[int, int]:
        self.feature[node], self.cut[node] = int(feature), float(cut)
        out = []
        for side, value in zip((self.left, self.right), counts, strict=True):
            side[node] = len(self.feature)
            out.append(side[node])
            for column, new in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1)):
                column.append(new)
            self.value.append(np.asarray(value, float).tolist())
        return out[0], out[1]

    def graft(self, node: int, other: Tree) -> None:
        """Put another tree in the place of a leaf."""
        place = [node, *range(len(self.feature), len(self.feature) + len(other.feature) - 1)]
        for name in ("feature", "cut", "left", "right", "value"):
            own, new = getattr(self, name), getattr(other, name)
            if name in ("left", "right"):
                new = [place[v] if v >= 0 else -1 for v in new]
            own[node] = new[0]
            own += new[1:]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row of ``x`` ends."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        node, live = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(live):
            at = node[live]
            inner = feature[at] >= 0
            live, at = live[inner], at[inner]
            if len(live):
                node[live] = np.where(x[live, feature[at]] > cut[at], right[at], left[at])
        return node


def gini(counts: np.ndarray) -> np.ndarray:
    """n times the Gini impurity of class counts along the last axis."""
    n = counts.sum(axis=-1)
    return n - (counts * counts).sum(axis=-1) / np.maximum(n, 1e-300)


@dataclass
class Rule:
    """How a node is split: at one cut drawn per feature (``random``), or at the best of all cuts."""

    classes: int
    features: int
    subset: int
    seed: int
    random: bool
    depth: int

    def draws(self, tree: int, path: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, tree, path])

    def candidates(self, rng: np.random.Generator, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Features that vary in the node, as many as the subset has, in an order drawn at random."""
        return np.array([f for f in rng.permutation(self.features) if low[f] < high[f]][: self.subset], np.int64)

    def grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, path: int, depth: int) -> Tree:
        """A whole subtree over its rows."""
        out = Tree()
        hot = np.zeros((len(y), self.classes))
        hot[np.arange(len(y)), y] = w
        out.value[0] = hot.sum(axis=0).tolist()
        todo = [(0, np.arange(len(y)), path, depth)]
        while todo:
            node, rows, path, depth = todo.pop()
            counts = np.array(out.value[node])
            if depth <= 0 or (counts > 0).sum() < 2:
                continue
            own, mine = x[rows], hot[rows]
            rng = self.draws(tree, path)
            found = self.best(own, mine, counts, rng)
            if found is None:
                continue
            feature, cut, left = found
            goes = own[:, feature] > cut
            kids = out.split(node, feature, cut, (left, counts - left))
            todo += [(kids[0], rows[~goes], 2 * path, depth - 1), (kids[1], rows[goes], 2 * path + 1, depth - 1)]
        return out

    def best(self, x: np.ndarray, hot: np.ndarray, counts: np.ndarray, rng: np.random.Generator):
        low, high = x.min(axis=0), x.max(axis=0)
        best = None
        for f in self.candidates(rng, low, high):
            if self.random:
                cuts = np.array([drawn_cut(rng, low[f], high[f])])
                lefts = hot[x[:, f] <= cuts[0]].sum(axis=0)[None, :]
            else:
                order = np.argsort(x[:, f], kind="stable")
                v = x[order, f]
                ends = np.flatnonzero(v[1:] > v[:-1])
                lefts = np.cumsum(hot[order], axis=0)[ends]
                cuts = v[ends] + (v[ends + 1] - v[ends]) / 2
                cuts = np.where(cuts < v[ends + 1], cuts, v[ends])
            score = gini(lefts) + gini(counts - lefts)
            i = int(np.argmin(score))
            if best is None or score[i] < best[0]:
                best = (score[i], int(f), float(cuts[i]), lefts[i])
        return best[1:] if best else None


def drawn_cut(rng: np.random.Generator, low: float, high: float) -> float:
    """Uniform in [low, high)."""
    cut = low + (high - low) * rng.random()
    return low if cut >= high else float(cut)


def matrices(batch: pa.RecordBatch, p: int, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and w (ones, if the rows have none) of a batch."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
    y = batch.column("y").to_numpy()
    if batch.schema.get_field_index("w") < 0:
        return x, y, np.ones((len(y), trees), np.int64)
    return x, y, batch.column("w").flatten().to_numpy().astype(np.int64).reshape(-1, trees)


class Grower:
    """Grows a forest over ``rows``: x array<double>, y int and, if rows are drawn, w array<int> with a count per tree."""

    def __init__(self, rows: DataFrame, trees: int, rule: Rule, local_rows: int = LOCAL_ROWS) -> None:
        self.rows, self.rule, self.local_rows = rows, rule, local_rows
        self.forest = [Tree() for _ in range(trees)]
        self.edges: list[list[float]] | None = None

    def run(self) -> list[Tree]:
        """The whole forest, put together on the driver."""
        places = self._tops()
        if places:
            self._graft(places, self._finish(places))
        return self.forest

    def state(self) -> dict:
        """``forest`` as plain lists; if that is too large, its tops, and in ``rest`` where the subtrees are and which meet."""
        places = self._tops()
        if not places:
            return {"forest": [vars(t) for t in self.forest]}
        path = self._finish(places)
        sizes = dict(_pieces(self.rows.sparkSession, path).select("slot", "nodes").toLocalIterator())  # a number per small node
        if sum(sizes.values()) * (self.rule.classes + 4) <= HELD_CELLS:
            self._graft(places, path)
            return {"forest": [vars(t) for t in self.forest]}
        bytes_of = sum(np.dtype(v).itemsize for n, v in KINDS.items() if n != "value") + self.rule.classes * np.dtype(KINDS["value"]).itemsize
        chunk = np.cumsum([sizes[slot] for slot in range(len(places))]) * bytes_of // CHUNK_BYTES
        rest = {"path": path, "places": [list(q[:2]) for q in places], "chunk": chunk.tolist(), "classes": self.rule.classes}
        return {"forest": [vars(t) for t in self.forest], "rest": rest}

    def _tops(self) -> list[tuple]:
        """Grow the large nodes; the small ones that are left, by tree."""
        k = self.rule.classes
        roots = [(tree, 0) for tree in range(len(self.forest))]
        counts = self._sums(roots, (k,), lambda x, y, w, slot, total, _: np.add.at(total, (slot, y), w), None)
        for tree, _ in roots:
            self.forest[tree].value[0] = counts[tree].tolist()
        # tree, node, path, depth left
        todo, small = [(tree, 0, 1, self.rule.depth) for tree, _ in roots], []
        while todo:
            large, rest = [], []
            for place in todo:
                value = np.array(self.forest[place[0]].value[place[1]])
                if place[3] > 0 and (value > 0).sum() > 1:
                    (large if value.sum() > self.local_rows else small).append(place)
            step = max(1, CELLS // (self.rule.features * max(2, (CUTS + 1) * k if not self.rule.random else k)))
            for start in range(0, len(large), step):
                rest += self._split(large[start : start + step])
            todo = rest
        return sorted(small)

    def _split(self, places: list[tuple]) -> list[tuple]:
        """Split large nodes; their children, if any."""
        found = self._drawn(places) if self.rule.random else self._binned(places)
        out = []
        for (tree, node, path, depth), best in zip(places, found, strict=True):
            if best is not None:
                feature, cut, left = best
                counts = np.array(self.forest[tree].value[node])
                kids = self.forest[tree].split(node, feature, cut, (left, counts - left))
                out += [(tree, kids[0], 2 * path, depth - 1), (tree, kids[1], 2 * path + 1, depth - 1)]
        return out

    def _drawn(self, places: list[tuple]) -> list:
        rule = self.rule
        low, high = self._extremes(places)
        cuts = []
        for slot, (tree, _, path, _) in enumerate(places):
            rng = rule.draws(tree, path)
            cuts.append([(int(f), drawn_cut(rng, low[slot, f], high[slot, f])) for f in rule.candidates(rng, low[slot], high[slot])])
        width = max(map(len, cuts), default=0)
        feature, cut = np.zeros((len(places), width), np.int64), np.full((len(places), width), np.inf)
        for slot, own in enumerate(cuts):
            for j, (f, v) in enumerate(own):
                feature[slot, j], cut[slot, j] = f, v

        def add(x, y, w, slot, total, shared):
            feature, cut = shared
            for j in range(feature.shape[1]):
                goes = x[np.arange(len(x)), feature[slot, j]] <= cut[slot, j]
                np.add.at(total, (slot[goes], j, y[goes]), w[goes])

        lefts = self._sums([p[:2] for p in places], (width, rule.classes), add, (feature, cut))
        out = []
        for slot, (own, (tree, node, _, _)) in enumerate(zip(cuts, places, strict=True)):
            counts = np.array(self.forest[tree].value[node])
            score = [gini(lefts[slot, j]) + gini(counts - lefts[slot, j]) for j in range(len(own))]
            j = int(np.argmin(score)) if own else -1
            out.append((*own[j], lefts[slot, j]) if own else None)
        return out

    def _binned(self, places: list[tuple]) -> list:
        """The best of the cuts at quantiles of the whole table, by histograms of the candidate features."""
        rule = self.rule
        if self.edges is None:
            probs = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
            columns = {str(f): F.get("x", F.lit(f)) for f in range(rule.features)}
            self.edges = [sorted(set(v or [])) for v in quantiles(self.rows, columns, probs).values()]
        low, high = self._extremes(places)
        chosen = [rule.candidates(rule.draws(tree, path), low[s], high[s]) for s, (tree, _, path, _) in enumerate(places)]
        feature = np.full((len(places), max(map(len, chosen), default=0)), -1)
        for slot, own in enumerate(chosen):
            feature[slot, : len(own)] = own

        def add(x, y, w, slot, total, shared):
            feature, edges = shared
            for j in range(feature.shape[1]):
                mine = feature[slot, j]
                for f in np.unique(mine[mine >= 0]).tolist():
                    rows = mine == f
                    np.add.at(total, (slot[rows], j, np.searchsorted(edges[f], x[rows, f], side="left"), y[rows]), w[rows])

        table = self._sums([p[:2] for p in places], (feature.shape[1], CUTS + 1, rule.classes), add, (feature, self.edges))
        out = []
        for slot, (own, (tree, node, _, _)) in enumerate(zip(chosen, places, strict=True)):
            counts, best = np.array(self.forest[tree].value[node]), None
            for j, f in enumerate(own.tolist()):
                lefts = np.cumsum(table[slot, j], axis=0)[: len(self.edges[f])]
                score = np.where((lefts.sum(axis=1) > 0) & (lefts.sum(axis=1) < counts.sum()), gini(lefts) + gini(counts - lefts), np.inf)
                i = int(np.argmin(score)) if len(score) else 0
                if len(score) and np.isfinite(score[i]) and (best is None or score[i] < best[0]):
                    best = (score[i], f, self.edges[f][i], lefts[i])
            out.append(best[1:] if best else None)
        return out

    def _visits(self, places: list[tuple[int, int]]):
        """A function that yields tree, rows (drawn, in an open node) and their slots for x and w."""
        forest = self.forest
        slots: dict[int, np.ndarray] = {}
        for slot, (tree, node) in enumerate(places):
            slots.setdefault(tree, np.full(len(forest[tree].feature), -1))[node] = slot
        needed = {tree: forest[tree] for tree in slots}

        def visits(x: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for tree, own in slots.items():
                drawn = np.flatnonzero(w[:, tree] > 0)
                at = own[needed[tree].route(x[drawn])]
                yield tree, drawn[at >= 0], at[at >= 0]

        return visits

    def _sums(self, places: list[tuple[int, int]], shape: tuple, add, shared) -> np.ndarray:
        """Arrays of counts per node, added up within tasks, then between them."""
        p, trees, visits = self.rule.features, len(self.forest), self._visits(places)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(places), *shape), np.int64)
            for batch in batches:
                x, y, w = matrices(batch, p, trees)
                for tree, rows, slot in visits(x, w):
                    add(x[rows], y[rows], w[rows, tree], slot, total, shared)
            flat = total.ravel()
            cells = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], ["cell", "n"])

        sums = self.rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(int(np.prod((len(places), *shape))), np.int64)
        out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
        return out.reshape(len(places), *shape)

    def _extremes(self, places: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        p, trees, visits = self.rule.features, len(self.forest), self._visits([q[:2] for q in places])
        count = len(places)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full((count, p), np.inf), np.full((count, p), -np.inf)
            for batch in batches:
                x, _, w = matrices(batch, p, trees)
                for _, rows, slot in visits(x, w):
                    order = np.argsort(slot, kind="stable")
                    starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
                    if len(starts):
                        named, own = slot[order][starts], x[rows[order]]
                        low[named] = np.fmin(low[named], np.fmin.reduceat(own, starts, axis=0))
                        high[named] = np.fmax(high[named], np.fmax.reduceat(own, starts, axis=0))
            cells = np.flatnonzero(low.ravel() <= high.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(low.ravel()[cells]), pa.array(high.ravel()[cells])], ["cell", "low", "high"])

        found = self.rows.mapInArrow(run, "cell long, low double, high double").groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        low, high = np.full(count * p, np.inf), np.full(count * p, -np.inf)
        low[found.column("cell").to_numpy()] = found.column("low").to_numpy()
        high[found.column("cell").to_numpy()] = found.column("high").to_numpy()
        return low.reshape(count, p), high.reshape(count, p)

    def _finish(self, places: list[tuple]) -> str:
        """Send the rows of small nodes to one task each, which grows the subtree; the folder where all are."""
        rule, p, trees = self.rule, self.rule.features, len(self.forest)
        visits = self._visits([q[:2] for q in places])
        names = ["slot", "x", "y", "w"]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, w = matrices(batch, p, trees)
                for tree, rows, slot in visits(x, w):
                    flat = pa.array(x[rows].ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, p, dtype=np.int32)), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(slot), lists, pa.array(y[rows], pa.int32()), pa.array(w[rows, tree])], names)

        def grow(table: pa.Table) -> pa.Table:
            slot = table.column("slot")[0].as_py()
            tree, _, path, depth = places[slot]
            # the order of equal rows does not matter, so none is made
            x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, p)
            grown = rule.grow(x, table.column("y").to_numpy(), table.column("w").to_numpy().astype(float), tree, path, depth)
            columns = {n: pa.array([np.asarray(getattr(grown, n), kind).tobytes()], pa.binary()) for n, kind in KINDS.items()}
            return pa.table({"slot": pa.array([slot], pa.int64()), "nodes": pa.array([len(grown.feature)], pa.int64())} | columns)

        dealt = self.rows.mapInArrow(deal, "slot long, x array<double>, y int, w long")
        return kept_copy(dealt.groupBy("slot").applyInArrow(grow, PIECE))

    def _graft(self, places: list[tuple], path: str) -> None:
        for r in _pieces(self.rows.sparkSession, path).orderBy("slot").toLocalIterator():
            tree, node, _, _ = places[r.slot]
            own = {n: np.frombuffer(r[n], kind) for n, kind in KINDS.items()}
            own["value"] = own["value"].reshape(-1, self.rule.classes).astype(float)
            self.forest[tree].graft(node, Tree(**{n: v.tolist() for n, v in own.items()}))


def _pieces(spark, path: str) -> DataFrame:
    return spark.read.schema(PIECE).parquet(path)


def with_shares(df: DataFrame, state: dict, features: list[Column], kept: list[Column]) -> DataFrame:
    """``kept`` columns of ``df`` and ``__prob``, the mean class shares of each row.

    Where the forest is too large for one task, a row goes once to each chunk of subtrees that it needs.
    """
    if "rest" not in state:
        return df.withColumn("__prob", shares(state["forest"], features))
    rest, p = state["rest"], len(features)
    spark, k, count = df.sparkSession, rest["classes"], len(state["forest"])
    tops = [Tree(**t) for t in state["forest"]]
    chunk_of, slots = np.array(rest["chunk"]), [np.full(len(t.feature), -1) for t in tops]
    for slot, (tree, node) in enumerate(rest["places"]):
        slots[tree][node] = slot
    values = []
    for tree, own in zip(tops, slots, strict=True):
        v = np.array(tree.value, float).reshape(-1, k)
        values.append(np.where(own[:, None] < 0, v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300), 0.0))

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)

    # ids are made once: the rows are written with them
    rows = cut_lineage(df.select(*kept, F.array(*features).alias("__x"), F.monotonically_increasing_id().alias("__id")))
    most = max(1, SLICE_BYTES // (8 * p))
    slices = max(1, -(-rows.count() // most))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            asked = np.zeros((len(x), int(chunk_of[-1]) + 1), bool)
            for tree, own in zip(tops, slots, strict=True):
                slot = own[tree.route(x)]
                at = np.flatnonzero(slot >= 0)
                asked[at, chunk_of[slot[at]]] = True
            for chunk in np.flatnonzero(asked.any(axis=0)).tolist():
                sent = batch.take(pa.array(np.flatnonzero(asked[:, chunk])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sent.num_rows, chunk, np.int32)), *sent.columns], ["chunk", "id", "slice", "x"])

    def score(pieces: pa.Table, part: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "p": pa.array([], pa.list_(pa.float64()))})
        x = matrix(part.column("x").combine_chunks())
        sizes = pieces.column("nodes").to_numpy()
        starts = np.cumsum(sizes) - sizes
        all_of = {n: np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in pieces.column(n)]) for n, kind in KINDS.items()}
        shift = np.repeat(starts, sizes)
        left, right = all_of["left"] + shift, all_of["right"] + shift
        value = all_of["value"].reshape(-1, k)
        held = pieces.column("slot").to_numpy()
        start_of = np.full(len(chunk_of), -1)
        start_of[held] = starts
        total = np.zeros((len(x), k))
        for tree in sorted({rest["places"][s][0] for s in held.tolist()}):
            slot = slots[tree][tops[tree].route(x)]
            live = np.flatnonzero((slot >= 0) & (start_of[slot] >= 0))
            node = start_of[slot[live]]
            own, ends = live, node.copy()
            index = np.arange(len(live))
            while len(index):
                at = ends[index]
                inner = all_of["feature"][at] >= 0
                index, at = index[inner], at[inner]
                if len(index):
                    ends[index] = np.where(x[own[index], all_of["feature"][at]] > all_of["cut"][at], right[at], left[at])
            v = value[ends].astype(float)
            total[own] += v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, k, dtype=np.int32)), pa.array(total.ravel()))
        return pa.table({"id": part.column("id"), "p": lists})

    near = rows.select(F.col("__id").alias("id"), F.pmod(F.xxhash64("__id"), F.lit(slices)).cast("int").alias("slice"), F.col("__x").alias("x"))
    dealt = near.mapInArrow(deal, "chunk int, id long, slice int, x array<double>")
    named = spark.createDataFrame([(s, int(v)) for s, v in enumerate(rest["chunk"])], "slot long, chunk int")  # a row per subtree
    pieces = _pieces(spark, rest["path"]).join(F.broadcast(named), "slot").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    met = pieces.groupBy("chunk", "slice").cogroup(dealt.groupBy("chunk", "slice")).applyInArrow(score, "id long, p array<double>")
    sums = met.groupBy(F.col("id").alias("__id")).agg(*[F.sum(F.get("p", F.lit(i))).alias(f"__s{i}") for i in range(k)])

    @F.pandas_udf("array<double>")
    def of_tops(x: pd.Series) -> pd.Series:
        own = np.array(x.tolist(), float).reshape(-1, p)
        return pd.Series(list(sum(v[tree.route(own)] for tree, v in zip(tops, values, strict=True))))

    found = rows.join(sums, "__id", "left").withColumn("__top", of_tops("__x"))
    each = [(F.get("__top", F.lit(i)) + F.coalesce(F.col(f"__s{i}"), F.lit(0.0))) / F.lit(count) for i in range(k)]
    return found.withColumn("__prob", F.array(*each)).drop("__id", "__x", "__top", *[f"__s{i}" for i in range(k)])


def shares(forest: list[dict], features: list[Column]) -> Column:
    """Mean class shares over the trees of each row's leaf, in Arrow batches."""
    trees = [Tree(**f) for f in forest]
    values = []
    for tree in trees:
        v = np.array(tree.value, float)
        values.append(v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300))
    p = len(features)

    @F.pandas_udf("array<double>")
    def scored(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist(), float).reshape(-1, p)
        total = sum(v[tree.route(rows)] for tree, v in zip(trees, values, strict=True)) / len(trees)
        return pd.Series(list(total))

    return scored(F.array(*features))
