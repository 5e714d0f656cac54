"""Aggregates that fits share: levels, class statistics, second moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table, c

MAX_LEVELS = 10_000
MAX_CLASSES = 10_000
# Up to here second moments are plain SUM expressions inside generated code;
# wider tables use one Arrow pass of BLAS products per batch.
EXPRESSION_WIDTH = 12
JOB_WIDTH = 400


class TooManyLevels(ValueError):
    """A column has more levels than a literal state may hold."""


def one_row(df: DataFrame, aggregates: dict[str, Column]) -> dict:
    """Run the aggregates and return their values by name.

    One job up to ``JOB_WIDTH`` aggregates. A wider table takes several, each
    reading only its own columns, so a columnar source is still read once and
    the generated code stays small.
    """
    names = list(aggregates)
    found: dict = {}
    for start in range(0, len(names), JOB_WIDTH):
        part = names[start : start + JOB_WIDTH]
        row = df.agg(*[aggregates[n].alias(f"a{i}") for i, n in enumerate(part)]).first()
        found |= {n: row[i] for i, n in enumerate(part)}
    return found


def unpivot(df: DataFrame, columns: dict[str, Column], keep: dict[str, Column] | None = None) -> DataFrame:
    """Long form (keep..., feature, value); one row per row and column."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("feature"), col.alias("value")) for n, col in columns.items()]
    )
    kept = [col.alias(n) for n, col in (keep or {}).items()]
    return df.select(*kept, F.explode(pairs).alias("p")).select(
        *[c(n) for n in (keep or {})], F.col("p.feature").alias("feature"), F.col("p.value").alias("value")
    )


#: A squared correlation this close to 1 is 1: rounding noise of a proportional column.
PERFECT = 1e-12


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null where a side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread_a, spread_b = F.var_pop(a), F.var_pop(b)
    r = F.covar_pop(a, b) / F.nullif(F.sqrt(spread_a) * F.sqrt(spread_b), F.lit(0.0))
    return F.when((spread_a > 0) & (spread_b > 0), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def level_counts(t: Table, columns: Sequence[str]) -> DataFrame:
    """(feature, level, n) with the missing level spelled 'NaN'."""
    texts = {n: F.coalesce(c(n).cast("string"), F.lit("NaN")) for n in columns}
    return (
        unpivot(t.df, texts)
        .groupBy("feature", F.col("value").alias("level"))
        .agg(F.count("*").alias("n"))
    )


def levels(t: Table, columns: Sequence[str], limit: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct levels per column; raises instead of collecting without bound."""
    if not columns:
        return {}
    bound = limit * len(columns)
    rows = level_counts(t, columns).select("feature", "level").limit(bound + 1).collect()
    found: dict[str, list[str]] = {n: [] for n in columns}
    for r in rows:
        found[r["feature"]].append(r["level"])
    wide = [n for n, v in found.items() if len(v) > limit]
    if len(rows) > bound or wide:
        raise TooManyLevels(f"more than {limit} levels in {wide or list(columns)}")
    return {n: sorted(v) for n, v in found.items()}


def classes(t: Table) -> list:
    rows = t.df.groupBy(c(t.label)).agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise TooManyLevels(f"more than {MAX_CLASSES} classes in {t.label}")
    return sorted((r[0] for r in rows if r[0] is not None))


def number_columns(t: Table, features: Sequence[str]) -> list[Column]:
    """The features as double columns __x0.. for an Arrow pass (no per-row arrays)."""
    return [t.number(n).alias(f"__x{i}") for i, n in enumerate(features)]


def number_matrix(pdf: pd.DataFrame, p: int) -> np.ndarray:
    return pdf[[f"__x{i}" for i in range(p)]].to_numpy(dtype=float)


@dataclass
class Moments:
    """Row count, mean vector and centred scatter matrix of the features."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def means(t: Table, features: Sequence[str]) -> tuple[int, np.ndarray]:
    row = one_row(t.df, {"": F.count("*"), **{n: F.avg(t.number(n)) for n in features}})
    return row[""], np.array([row[n] if row[n] is not None else 0.0 for n in features])


def moments(
    t: Table, features: Sequence[str] | None = None, centre: bool = True, by_class: bool = False
) -> Moments | dict:
    """Second moments in two passes: means, then products of centred values.

    With ``by_class`` the scatter is split by label and centred at the class
    means; the result is a dict label -> Moments. Driver state is
    O(classes * p * p), independent of the number of rows.
    """
    features = list(t.features if features is None else features)
    if by_class:
        return _class_moments(t, features)
    n, mean = means(t, features)
    at = mean if centre else np.zeros(len(features))
    return Moments(n, mean, _scatter(t, features, at))


def _scatter(t: Table, features: list[str], at: np.ndarray) -> np.ndarray:
    p = len(features)
    if p <= EXPRESSION_WIDTH:
        x = [t.number(n) - F.lit(float(m)) for n, m in zip(features, at)]
        row = one_row(t.df, {f"{i},{j}": F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p)})
        s = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                s[i, j] = s[j, i] = row[f"{i},{j}"] or 0.0
        return s
    totals = _arrow_scatter(t, features, at.reshape(1, -1), None)
    return totals[0] if 0 in totals else np.zeros((p, p))


def _arrow_scatter(t: Table, features: list[str], at: np.ndarray, label_index: Column | None) -> dict:
    """Sum of centred outer products per class index, via partial sums per partition."""
    p = len(features)
    index = label_index if label_index is not None else F.lit(0)
    data = t.df.select(index.cast("int").alias("k"), *number_columns(t, features)).where(F.col("k").isNotNull())
    centres = at

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = number_matrix(pdf, p)
            ks = pdf["k"].to_numpy()
            for k in np.unique(ks):
                part = x[ks == k] - centres[k]
                sums[int(k)] = sums.get(int(k), 0.0) + part.T @ part
        for k, s in sums.items():
            yield pd.DataFrame({"k": [k], "s": [s.ravel()]})

    parts = data.mapInPandas(partial, "k int, s array<double>")
    cells = parts.select("k", F.posexplode("s").alias("i", "s")).groupBy("k", "i").agg(F.sum("s").alias("s"))
    totals: dict[int, np.ndarray] = {}
    for r in cells.collect():  # classes * p * p cells
        totals.setdefault(r["k"], np.zeros(p * p))[r["i"]] = r["s"]
    return {k: v.reshape(p, p) for k, v in totals.items()}


@dataclass
class ClassStats:
    """Per class: rows, sums/means/population variances of every feature."""

    labels: list
    n: np.ndarray
    mean: np.ndarray
    var: np.ndarray


def class_stats(t: Table, features: Sequence[str] | None = None) -> ClassStats:
    """One grouped pass with map-side partial aggregation."""
    features = list(t.features if features is None else features)
    aggs = [F.count("*").alias("n")]
    for i, name in enumerate(features):
        aggs += [F.avg(t.number(name)).alias(f"m{i}"), F.var_pop(t.number(name)).alias(f"v{i}")]
    rows = t.df.where(c(t.label).isNotNull()).groupBy(c(t.label).alias("y")).agg(*aggs).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise TooManyLevels(f"more than {MAX_CLASSES} classes in {t.label}")
    rows = sorted(rows, key=lambda r: r["y"])
    p = range(len(features))
    return ClassStats(
        [r["y"] for r in rows],
        np.array([r["n"] for r in rows], dtype=float),
        np.array([[r[f"m{i}"] for i in p] for r in rows], dtype=float),
        np.array([[r[f"v{i}"] for i in p] for r in rows], dtype=float),
    )


def class_index(t: Table, labels: Sequence) -> Column:
    """Zero-based position of the label in ``labels`` (null when not there)."""
    position = F.array_position(F.array(*[F.lit(v) for v in labels]), c(t.label))
    return F.when(position > 0, position - 1).cast("int")


def _class_moments(t: Table, features: list[str]) -> dict:
    stats = class_stats(t, features)
    p = len(features)
    if p <= EXPRESSION_WIDTH and len(stats.labels) * p * p <= 2000:
        k = class_index(t, stats.labels)
        arrays = [F.array(*[F.lit(float(m)) for m in stats.mean[:, i]]) for i in range(p)]
        x = [t.number(n) - F.get(arrays[i], F.col("__k")) for i, n in enumerate(features)]
        aggs = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
        rows = t.df.withColumn("__k", k).where("__k is not null").groupBy("__k").agg(*aggs).collect()
        scatter = {}
        for r in rows:
            s = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    s[i, j] = s[j, i] = r[f"s{i}_{j}"]
            scatter[r["__k"]] = s
    else:
        scatter = _arrow_scatter(t, features, stats.mean, class_index(t, stats.labels))
    return {
        y: Moments(int(stats.n[i]), stats.mean[i], scatter[i]) for i, y in enumerate(stats.labels)
    }
