"""Meta-features of many datasets that share one table, in a number of jobs that does not depend on how many there are.

``group`` names the column that tells the datasets apart. Levels, classes and moments are aggregates
keyed by it, with partial sums before each shuffle, so one dataset may hold most of the rows. Per-dataset values
go back to the rows by a broadcast while their table is small (counted), else by a join whose keys are dealt
to ``SALT`` copies of it. Products of columns are added up per dataset in each partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import CLASSIFICATION, Table, c
from tabloom.functions.rank import ROWS_PER_RANGE, running_total
from tabloom.functions.stats import Moments, correlation
from tabloom.operators.decompose import principal_axes
from tabloom.plans.pairs import contingency
from tabloom.plans.profile import CLASSES, CORRELATIONS, COUNTS, PCA, SHAPES, SYMBOLS
from tabloom.session import cut_lineage

GROUPED = (*COUNTS, *CLASSES, *SYMBOLS, *SHAPES, *PCA, *CORRELATIONS)
#: Cells (rows times columns) of a table that is broadcast; beyond, the join is salted.
BROADCAST_CELLS = 1_000_000
SALT = 32
#: Products a task holds before it hands them on.
PRODUCTS = 4_000_000
LEAST_PAIRS = 50


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], cells: int = BROADCAST_CELLS, salt: int = SALT) -> DataFrame:
    """Left join with a table of unique keys, without a hot task for a hot key."""
    bound = cells // len(table.columns)
    if table.limit(bound + 1).count() <= bound:
        return rows.join(F.broadcast(table), list(keys), "left")
    dealt = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salt)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return dealt.join(copies, [*keys, "__salt"], "left").drop("__salt")


def products(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(g, i, j, s): sums of products of two columns per group, for i <= j."""
    p = len(columns)
    i, j = np.triu_indices(p)
    schema = "g string, i int, j int, s double"

    def rows(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        names = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), len(i))))
        sums = np.concatenate([m[i, j] for m in held.values()])
        parts = [names, pa.array(np.tile(i, len(held)), pa.int32()), pa.array(np.tile(j, len(held)), pa.int32()), pa.array(sums)]
        return pa.RecordBatch.from_arrays(parts, names=["g", "i", "j", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(p)])
            coded = batch.column(0).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(coded.dictionary)), "right")
            start = 0
            for name, end in zip(coded.dictionary.to_pylist(), ends):
                part = x[order[start:end]]
                held[name] = held.get(name, 0.0) + part.T @ part
                start = end
                if len(held) * p * p > PRODUCTS:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    chosen = df.select(c(group), *[c(n) for n in columns])
    return chosen.mapInArrow(run, schema).groupBy("g", "i", "j").agg(F.sum("s").alias("s"))


def leading_axes(sums: DataFrame, p: int) -> DataFrame:
    """(g, share95, axis): share of components for 95 % of the variance and the first axis, per group."""
    target = pa.schema([("g", pa.string()), ("share95", pa.float64()), ("axis", pa.list_(pa.float64()))])

    def solve(key: tuple, cells: pa.Table) -> pa.Table:
        scatter = np.zeros((p, p))
        i, j, s = (cells[n].to_numpy() for n in ("i", "j", "s"))
        scatter[i, j] = scatter[j, i] = s
        variance, axes = principal_axes(Moments(2, np.zeros(p), scatter))
        share = np.cumsum(variance) / (variance.sum() or 1.0)
        wanted = (int(np.searchsorted(share, 0.95 - 1e-12)) + 1) / p
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([wanted]), pa.array([axes[0].tolist()], target.field("axis").type)], schema=target)

    return sums.groupBy("g").applyInArrow(solve, "g string, share95 double, axis array<double>")


def _over(values: list[Column]) -> list[Column]:
    """Smallest, largest, mean and spread of several columns of a row."""
    cells, n = F.array(*values), float(len(values))
    mean = F.aggregate(cells, F.lit(0.0), lambda s, v: s + v) / n
    return [F.array_min(cells), F.array_max(cells), mean, F.sqrt(F.aggregate(cells, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)]


def _usable(value: Column) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def _counts(t: Table, n: Column, bad: Column, gaps: list[Column]) -> dict[str, Column]:
    p, numeric, nominal = float(len(t.features)), float(len(t.numeric)), float(len(t.categorical))
    cells = sum(gaps, F.lit(0)).cast("double")
    columns = sum(((g > 0).cast("int") for g in gaps), F.lit(0)).cast("double")
    ratio, inverse = F.lit(p) / n, n / F.lit(p + 1e-7)
    values = [
        n, F.log(n), F.lit(p), F.log(F.lit(p)), bad, bad / n, columns, columns / p, cells, cells / (n * p), F.lit(numeric), F.lit(nominal),
        F.lit(numeric / nominal if nominal else 0.0), F.lit(nominal / numeric if numeric else 0.0), ratio, F.log(ratio), inverse, F.log(inverse),
    ]
    return dict(zip(COUNTS, values))


def grouped_profile(t: Table, group: str, names: Iterable[str] = GROUPED, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(group, name, value): the meta-features of every dataset, as of its rows alone.

    Levels and classes are numbered within their dataset. A missing group reads 'NaN'; a numeric column
    without any value in a dataset counts as 0; a table without rows or features gives no rows. Landmarks train
    learners and are left to ``metafeature_profile`` of one dataset.
    """
    wanted = [n for n in GROUPED if n in set(names) and (t.task == CLASSIFICATION or n not in CLASSES)]
    spark = t.df.sparkSession
    if not t.features or not wanted:
        return spark.createDataFrame([], "group string, name string, value double")
    has = lambda part: bool(set(part) & set(wanted))
    text = lambda n: F.coalesce(c(n).cast("string"), F.lit("NaN"))
    label = c(t.label) if t.label else F.lit(None).cast("double")
    numbers, levels = len(t.numeric), len(t.categorical)
    features = [f"v{i}" for i in range(numbers + levels)]
    rows = t.df.select(
        text(group).alias("g"),
        label.alias("y"),
        *[t.number(n).alias(f"v{i}") for i, n in enumerate(t.numeric)],
        *[text(n).alias(f"t{j}") for j, n in enumerate(t.categorical)],
    )
    met = cut_lineage(rows.groupBy("g", "y").agg(F.count("*").alias("n")))
    wide: list[DataFrame] = []
    found: dict[str, Column] = {}

    if t.task == CLASSIFICATION and has(CLASSES):
        total, n = F.sum("n"), F.col("n").cast("double")
        entropy = F.when(F.count("*") == 1, 0.0).otherwise(F.log2(total) - F.sum(n * F.log2(n)) / total)
        cells = (F.count("*"), F.min("n") / total, F.max("n") / total, 1 / F.count("*"), F.stddev_pop("n") / total, entropy)
        wide.append(met.groupBy("g").agg(*[v.cast("double").alias(k) for k, v in zip(CLASSES, cells)]))
        found |= {k: F.col(k) for k in CLASSES}

    if levels:
        sides = [F.col("g"), *[F.col(f"t{j}") for j in range(levels)]]
        seen = cut_lineage(contingency(rows, sides, [(0, j + 1) for j in range(levels)]))
        if has(SYMBOLS):
            sizes = seen.groupBy("x", "pair").agg(F.count("*").alias("n")).groupBy(F.col("x").alias("g"))
            cells = [fn("n").cast("double") for fn in (F.min, F.max, F.avg, F.stddev_pop, F.sum)]
            wide.append(sizes.agg(*[v.alias(k) for k, v in zip(SYMBOLS, cells)]))
        numbered = cut_lineage(running_total(seen, ["y"], ["pair", "x"], out="code", rows_per_range=rows_per_range))
        for j in range(levels):
            codes = numbered.where(F.col("pair") == j)
            codes = codes.select(F.col("x").alias("g"), F.col("y").alias(f"t{j}"), F.col("code").cast("double").alias(f"v{numbers + j}"))
            rows = attach(rows, codes, ["g", f"t{j}"])
    found |= {k: F.col(k) if levels else F.lit(0.0) for k in SYMBOLS}

    if t.task == CLASSIFICATION:
        index = running_total(met.where(F.col("y").isNotNull()).select("g", "y"), ["y"], ["g"], out="k", rows_per_range=rows_per_range)
        rows = attach(rows, index.select("g", "y", F.col("k").cast("double").alias("k")), ["g", "y"])
    else:
        rows = rows.withColumn("k", F.col("y").cast("double"))
    rows = cut_lineage(rows.select("g", "k", *features))

    gaps = [F.col(f).isNull() | (F.abs(f) == float("inf")) for f in features[:numbers]]
    hit = F.greatest(F.lit(0), *[g.cast("int") for g in gaps])
    share = lambda f: F.sqrt(F.count(f) / F.count("*"))  # noqa: E731 - missing values are filled by the mean
    base = rows.groupBy("g").agg(
        F.count("*").cast("double").alias("n"),
        F.sum(hit).cast("double").alias("bad"),
        *[F.sum(g.cast("bigint")).alias(f"g{i}") for i, g in enumerate(gaps)],
        *[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"m{i}") for i, f in enumerate(features)],
        *[(F.coalesce(F.stddev_pop(f), F.lit(0.0)) * share(f)).alias(f"s{i}") for i, f in enumerate(features)],
    )
    base = cut_lineage(base)
    found |= _counts(t, F.col("n"), F.col("bad"), [F.col(f"g{i}") for i in range(numbers)])

    if has(SHAPES) or has(PCA) or has(CORRELATIONS):
        centres = base.select("g", *[f"m{i}" for i in range(len(features))], *[f"s{i}" for i in range(len(features))])
        full = attach(rows, centres, ["g"])
        gap = [F.coalesce(F.col(f), F.col(f"m{i}")) - F.col(f"m{i}") for i, f in enumerate(features)]
        cells = [a.alias(f"{k}{i}") for i, v in enumerate(gap) for k, a in (("ku", _usable(F.kurtosis(v))), ("sk", _usable(F.skewness(v))))]
        for i, f in enumerate(features):
            both = F.sum((F.col(f).isNotNull() & F.col("k").isNotNull()).cast("bigint"))
            cells.append(F.when(both >= LEAST_PAIRS, _usable(correlation(F.col(f), F.col("k")))).otherwise(0.0).alias(f"r{i}"))
        wide.append(full.groupBy("g").agg(*cells))
        at = range(len(features))
        shapes = [*_over([F.col(f"ku{i}") for i in at]), *_over([F.col(f"sk{i}") for i in at])]
        found |= dict(zip(SHAPES, shapes)) | dict(zip(CORRELATIONS, _over([F.col(f"r{i}") for i in at])[2:]))
        if has(PCA):
            scaled = full.select("g", *[F.when(F.col(f"s{i}") > 0, v / F.col(f"s{i}")).otherwise(v).alias(f"z{i}") for i, v in enumerate(gap)])
            axes = cut_lineage(leading_axes(products(scaled, "g", [f"z{i}" for i in at]), len(features)))
            first = attach(scaled, axes.select("g", "axis"), ["g"])
            score = sum((F.col(f"z{i}") * F.col("axis")[i] for i in at), F.lit(0.0))
            wide.append(axes.select("g", F.col("share95").alias(PCA[0])))
            wide.append(first.groupBy("g").agg(F.kurtosis(score).alias(PCA[1]), F.skewness(score).alias(PCA[2])))
            found |= {k: F.col(k) for k in PCA}

    out = base
    for part in wide:
        out = out.join(part, "g")
    cells = F.array(*[F.struct(F.lit(n).alias("name"), found[n].cast("double").alias("value")) for n in wanted])
    return out.select(F.col("g").alias("group"), F.explode(cells).alias("s")).select("group", "s.name", "s.value")
