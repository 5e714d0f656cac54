"""Rank correlation and contingency counts of many column pairs in a bounded number of passes.

Ranks. Every column is cut at sampled edges. A row that holds an edge knows its rank from the
counts of the cells alone, so a value that many rows share is never gathered; rows between two
edges are sorted within their cell (first shuffle) and all ranks of a block of rows meet again
in one task (second shuffle), which returns one row of moments per pair. The number of shuffles
does not depend on the number of columns, and no shuffle is keyed by a value.

Counts. A task keeps one table of counts per pair, dense where the levels are few, and hands
them on when they outgrow a limit. Rows themselves are neither exploded nor shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table, c
from tabloom.functions.rank import ONE_RANGE, ROWS_PER_RANGE, SAMPLED_PER_RANGE
from tabloom.session import cut_lineage

Pairs = Sequence[tuple[str, str]]
#: Counts a task holds before it hands them on, and the characters of the levels beside them.
CELLS = 4_000_000
LEVEL_CHARACTERS = 64_000_000
#: Pairs with more possible cells than this are counted by sorting, others in an array.
DENSE = 65_536
ROWS_OUT = 50_000

PLACED = "block long, pos int, col int, cell int, value double"
RANKED = "block long, pos int, col int, rank double"
MOMENTS = "pair int, n long, a double, b double, ab double, aa double, bb double, alo double, ahi double, blo double, bhi double"
COUNTS = "pair int, x string, y string, n long"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _batch(schema: str, *columns) -> pa.RecordBatch:
    target = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, target)], schema=target)


def _column(batch: pa.RecordBatch | pa.Table, i: int) -> np.ndarray:
    """Doubles, missing ones as NaN."""
    return batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)


# Ranks


def cells_of(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """2 i + 1 on edge i, 2 i between edges i - 1 and i."""
    left = np.searchsorted(edges, values, "left")
    return left + np.searchsorted(edges, values, "right")


def column_edges(df: DataFrame, columns: int, rows: int, rows_per_range: int) -> list[np.ndarray]:
    """Ascending distinct cut points per column from one bounded sample of the rows."""
    ranges = math.ceil(rows / rows_per_range)
    if rows > ONE_RANGE:
        ranges = max(ranges, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if ranges <= 1:
        return [np.empty(0)] * columns
    drawn = df.sample(False, min(1.0, SAMPLED_PER_RANGE * ranges / rows), 7).toPandas().to_numpy(np.float64)
    out = []
    for i in range(columns):
        s = np.sort(drawn[~np.isnan(drawn[:, i]), i])
        out.append(np.unique(s[len(s) * np.arange(1, ranges) // ranges]) if len(s) else np.empty(0))
    return out


def rank_moments(ranks: np.ndarray, pairs: Iterable[tuple[int, int]]) -> list[tuple]:
    """Per pair: rows where both are there, their sums, products, smallest and largest ranks."""
    there = ~np.isnan(ranks)
    filled = np.where(there, ranks, 0.0)
    mask = there.astype(np.float64)
    n, products = mask.T @ mask, filled.T @ filled
    sums, squares = filled.T @ mask, (filled * filled).T @ mask
    whole = there.all(axis=0)
    low, high = np.where(there, ranks, np.inf).min(axis=0), np.where(there, ranks, -np.inf).max(axis=0)
    out = []
    for k, (i, j) in enumerate(pairs):
        if not n[i, j]:
            continue
        ends = low[i], high[i], low[j], high[j]
        if not (whole[i] and whole[j]):
            both = ranks[there[:, i] & there[:, j]]
            ends = both[:, i].min(), both[:, i].max(), both[:, j].min(), both[:, j].max()
        out.append((k, int(n[i, j]), sums[i, j], sums[j, i], products[i, j], squares[i, j], squares[j, i], *ends))
    return out


def rank_correlation(t: Table, pairs: Pairs, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(a, b, value): rank correlation over rows where both are there; null where a side does not vary.

    Ranks are those of the whole column, ties share their mean. The values are written once
    (``cut_lineage``): three passes read them, and rows keep their numbers when a task runs again.
    An empty table gives null for every pair.
    """
    spark = t.df.sparkSession
    names = sorted({n for pair in pairs for n in pair})
    at = {n: i for i, n in enumerate(names)}
    wanted = [(at[a], at[b]) for a, b in pairs]
    values = [(t.number(n) + F.lit(0.0)).alias(f"v{i}") for i, n in enumerate(names)]
    # The partition is written too: a task of a union has another number than the part it reads.
    held = cut_lineage(t.df.select(*values, F.spark_partition_id().alias("part")))
    edges = column_edges(held, len(names), held.count(), rows_per_range)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(2 * len(e) + 1, np.int64) for e in edges]
        for batch in batches:
            for i, e in enumerate(edges):
                v = _column(batch, i)
                found[i] += np.bincount(cells_of(v[~np.isnan(v)], e), minlength=len(found[i]))
        for i, f in enumerate(found):
            cell = np.flatnonzero(f)
            yield _batch("col int, cell int, n long", np.full(len(cell), i), cell, f[cell])

    counted = held.mapInArrow(count, "col int, cell int, n long").groupBy("col", "cell").agg(F.sum("n").alias("n"))
    # One number per cell: columns times twice the ranges.
    sizes = [np.zeros(2 * len(e) + 1, np.int64) for e in edges]
    for col, cell, n in counted.collect():
        sizes[col][cell] = n
    before = [np.cumsum(s) - s for s in sizes]
    middle = [(s.sum() + 1) / 2 for s in sizes]

    def place(known: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, batch in enumerate(b for b in batches if b.num_rows):
                number = (batch.column(len(edges))[0].as_py() << 32) + k
                for i, e in enumerate(edges):
                    v = _column(batch, i)
                    pos = np.flatnonzero(~np.isnan(v))
                    cell = cells_of(v[pos], e)
                    chosen = cell % 2 == known
                    pos, cell = pos[chosen], cell[chosen]
                    block, col = np.full(len(pos), number), np.full(len(pos), i)
                    if known:
                        yield _batch(RANKED, block, pos, col, before[i][cell] + (sizes[i][cell] + 1) / 2 - middle[i])
                    else:
                        yield _batch(PLACED, block, pos, col, cell, v[pos])

        return run

    def rank(key: tuple, cell: pa.Table) -> pa.Table:
        i, k = key[0].as_py(), key[1].as_py()
        _, inverse, n = np.unique(cell["value"].to_numpy(), return_inverse=True, return_counts=True)
        ranks = before[i][k] + np.cumsum(n) - n + (n + 1) / 2 - middle[i]
        return pa.Table.from_arrays([cell["block"], cell["pos"], cell["col"], pa.array(ranks[inverse])], schema=_arrow(RANKED))

    def moments(block: pa.Table) -> pa.Table:
        pos, col = block["pos"].to_numpy(), block["col"].to_numpy()
        ranks = np.full((int(pos.max()) + 1, len(names)), np.nan)
        ranks[pos, col] = block["rank"].to_numpy()
        found = rank_moments(ranks, wanted)
        columns = list(zip(*found)) or [[] for _ in _arrow(MOMENTS)]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _arrow(MOMENTS))], schema=_arrow(MOMENTS))

    ranked = held.mapInArrow(place(False), PLACED).groupBy("col", "cell").applyInArrow(rank, RANKED)
    if any(len(e) for e in edges):
        ranked = ranked.unionByName(held.mapInArrow(place(True), RANKED))
    parts = ranked.groupBy("block").applyInArrow(moments, MOMENTS)
    ends = [fn(k).alias(k) for fn, keys in ((F.min, ("alo", "blo")), (F.max, ("ahi", "bhi"))) for k in keys]
    total = parts.groupBy("pair").agg(*[F.sum(k).alias(k) for k in ("n", "a", "b", "ab", "aa", "bb")], *ends)
    spread = lambda q, s: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    r = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.nullif(F.sqrt(spread("aa", "a") * spread("bb", "b")), F.lit(0.0))
    varies = (F.col("ahi") > F.col("alo")) & (F.col("bhi") > F.col("blo"))
    value = F.when(varies, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    listed = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return listed.join(total.select("pair", value.alias("value")), "pair", "left").select("a", "b", "value")


# Contingency counts


class Contingency:
    """Counts of level pairs, for many pairs of columns at once; a side of None has one level, ''."""

    def __init__(self, columns: int, pairs: Sequence[tuple[int, int | None]]):
        self.columns, self.pairs = columns, pairs
        self.clear()

    def clear(self) -> None:
        self.levels: list[dict[str, int]] = [{} for _ in range(self.columns)]
        self.dense: dict[int, np.ndarray] = {}
        self.sparse: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.characters = self.loose = self.filled = 0

    def codes(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for i, known in enumerate(self.levels):
            coded = batch.column(i).dictionary_encode()
            texts = coded.dictionary.to_pylist()
            self.characters += sum(len(s) for s in texts if s not in known)
            numbers = np.array([known.setdefault(s, len(known)) for s in texts], np.int64)
            out.append(numbers[coded.indices.to_numpy(zero_copy_only=False)])
        return out

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Count a batch; what outgrows the limits comes out."""
        codes = self.codes(batch)
        for k, (i, j) in enumerate(self.pairs):
            rows, columns = len(self.levels[i]), 1 if j is None else len(self.levels[j])
            if rows * columns <= DENSE:
                flat = codes[i] if j is None else codes[i] * columns + codes[j]
                found = np.bincount(flat, minlength=rows * columns).reshape(rows, columns)
                old = self.dense.get(k)
                if old is not None:
                    found[: old.shape[0], : old.shape[1]] += old
                    self.filled -= old.size
                self.dense[k] = found
                self.filled += found.size
            else:
                flat = codes[i] << 32 if j is None else (codes[i] << 32) | codes[j]
                cells, n = np.unique(flat, return_counts=True)
                self.sparse.setdefault(k, []).append((cells, n))
                self.loose += len(cells)
            if self.loose + self.filled > CELLS:
                self.merge()
                # Half of the room must be free after a merge, or each pair would merge again.
                if self.loose + self.filled > CELLS // 2:
                    yield from self.drain()
        if self.characters > LEVEL_CHARACTERS:
            yield from self.drain()
            self.clear()

    def merge(self) -> None:
        self.loose = 0
        for k, parts in self.sparse.items():
            cells, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([p[1] for p in parts]), len(cells)).astype(np.int64)
            self.sparse[k] = [(cells, n)]
            self.loose += len(cells)

    def drain(self) -> Iterator[pa.RecordBatch]:
        """All counts as rows; the levels keep their numbers."""
        self.merge()
        texts = [pa.array(list(known), pa.string()) for known in self.levels]
        held: list[tuple] = []
        size = 0
        for k, (i, j) in enumerate(self.pairs):
            cells = list(self.sparse.get(k, ()))
            if k in self.dense:
                x, y = np.nonzero(self.dense[k])
                cells.append(((x << 32) | y, self.dense[k][x, y]))
            for cell, n in cells:
                for s in range(0, len(cell), ROWS_OUT):
                    x, y = cell[s : s + ROWS_OUT] >> 32, cell[s : s + ROWS_OUT] & 0xFFFFFFFF
                    right = pa.array([""] * len(y), pa.string()) if j is None else texts[j].take(pa.array(y))
                    held.append((np.full(len(x), k), texts[i].take(pa.array(x)), right, n[s : s + ROWS_OUT]))
                    size += len(x)
                    if size >= ROWS_OUT:
                        yield self.rows(held)
                        held, size = [], 0
        if held:
            yield self.rows(held)
        self.dense, self.sparse, self.loose, self.filled = {}, {}, 0, 0

    @staticmethod
    def rows(held: list[tuple]) -> pa.RecordBatch:
        k, x, y, n = zip(*held)
        return _batch(COUNTS, np.concatenate(k), pa.concat_arrays(x), pa.concat_arrays(y), np.concatenate(n))


def contingency(df: DataFrame, texts: Sequence[Column], pairs: Sequence[tuple[int, int | None]]) -> DataFrame:
    """(pair, x, y, n): how often levels of two columns meet; ``pairs`` are positions in ``texts``.

    Texts must not be null. With None as the second position, levels of one column are counted.
    """
    width = len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Contingency(width, pairs)
        for batch in batches:
            if batch.num_rows:
                yield from held.add(batch)
        yield from held.drain()

    coded = df.select(*[x.alias(f"t{i}") for i, x in enumerate(texts)])
    return coded.mapInArrow(run, COUNTS).groupBy("pair", "x", "y").agg(F.sum("n").alias("n"))


def pair_entropies(t: Table, pairs: Pairs) -> DataFrame:
    """(a, b, hx, hy, hxy): entropies in nats of both columns and of the pair, missing counted as a level 'NaN'.

    A column's entropy is worked out once, whatever the number of its pairs.
    """
    names = sorted({n for pair in pairs for n in pair})
    at = {n: i for i, n in enumerate(names)}
    sides = [(at[a], at[b]) for a, b in pairs] + [(i, None) for i in range(len(names))]
    counts = contingency(t.df, [F.coalesce(c(n).cast("string"), F.lit("NaN")) for n in names], sides)
    total, n = F.sum("n"), F.col("n").cast("double")
    h = F.when(F.count("*") == 1, 0.0).otherwise(F.log(total) - F.sum(n * F.log(n)) / total)
    single = len(pairs)
    roles = [
        row
        for k, (a, b) in enumerate(pairs)
        for row in ((k, a, b, "hxy", k), (k, a, b, "hx", single + at[a]), (k, a, b, "hy", single + at[b]))
    ]
    listed = t.df.sparkSession.createDataFrame(roles, "k int, a string, b string, role string, pair int")
    found = listed.join(counts.groupBy("pair").agg(h.alias("h")), "pair")
    return found.groupBy("k", "a", "b").agg(*[F.max(F.when(F.col("role") == r, F.col("h"))).alias(r) for r in ("hx", "hy", "hxy")])
