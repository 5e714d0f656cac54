"""Statistics of single columns and column pairs, and summaries over them."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import Table, c, is_numeric
from tabloom.functions.rank import ROWS_PER_RANGE, running_total
from tabloom.functions.stats import correlation, unpivot
from tabloom.plans.pairs import pair_entropies, rank_correlation

SCHEMA = "grp string, mf string, a string, b string, value double"
NUMERIC_ONE = {"mean": F.avg, "std": F.stddev_pop, "kurtosis": F.kurtosis, "skew": F.skewness}


def _empty(t: Table) -> DataFrame:
    return t.df.sparkSession.createDataFrame([], SCHEMA)


def _labelled(df: DataFrame, group: str, mf: str, a: Column, b: Column, value: Column) -> DataFrame:
    return df.select(
        F.lit(group).alias("grp"), F.lit(mf).alias("mf"), a.alias("a"), b.alias("b"), value.cast("double").alias("value")
    )


def numeric_statistics(t: Table, columns: list[str], group: str = "Features") -> DataFrame:
    """Mean, std, kurtosis and skew (population) of numeric columns in one pass."""
    if not columns:
        return _empty(t)
    row = t.df.agg(
        *[fn(t.number(n)).alias(f"{k}{i}") for i, n in enumerate(columns) for k, fn in NUMERIC_ONE.items()]
    )
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("mf"), F.lit(n).alias("a"), F.col(f"{k}{i}").cast("double").alias("value"))
            for i, n in enumerate(columns)
            for k in NUMERIC_ONE
        ]
    )
    long = row.select(F.explode(cells).alias("s"))
    return long.select(F.lit(group).alias("grp"), "s.mf", "s.a", F.lit(None).cast("string").alias("b"), "s.value")


def missing_values(t: Table, columns: list[str], group: str = "Features") -> DataFrame:
    """Number of missing values per column."""
    gap = {n: (t.number(n) if is_numeric(t.dtype(n)) else c(n)).isNull().cast("bigint") for n in columns}
    row = t.df.agg(*[F.sum(g).alias(f"g{i}") for i, g in enumerate(gap.values())])
    long = unpivot(row, {n: F.col(f"g{i}") for i, n in enumerate(columns)})
    return _labelled(long, group, "missing_values", F.col("feature"), F.lit(None).cast("string"), F.col("value"))


def entropy(t: Table, columns: list[str], group: str = "Features") -> DataFrame:
    """Base-2 entropy of the level shares of categorical columns."""
    if not columns:
        return _empty(t)
    levels = {n: F.coalesce(c(n).cast("string"), F.lit("NaN")) for n in columns}
    counts = unpivot(t.df, levels).groupBy("feature", "value").agg(F.count("*").alias("n"))
    h = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    return _labelled(
        counts.groupBy("feature").agg(h.alias("h")), group, "entropy", F.col("feature"), F.lit(None).cast("string"), F.col("h")
    )


def mutual_information(t: Table, pairs: list[tuple[str, str]], group: str = "Features", average: str = "geometric") -> DataFrame:
    """Normalised mutual information of categorical pairs from their contingency counts."""
    if not pairs:
        return _empty(t)
    scored = pair_entropies(t, pairs)
    mi = F.greatest(F.col("hx") + F.col("hy") - F.col("hxy"), F.lit(0.0))
    scale = F.sqrt(F.col("hx") * F.col("hy")) if average == "geometric" else (F.col("hx") + F.col("hy")) / 2
    value = F.when(scale == 0, F.when((F.col("hx") == 0) & (F.col("hy") == 0), 1.0).otherwise(0.0)).otherwise(mi / scale)
    return _labelled(scored, group, "mutual_information", F.col("a"), F.col("b"), value)


def pearson(t: Table, pairs: list[tuple[str, str]], group: str = "Features") -> DataFrame:
    """Correlation of numeric pairs in one pass; null where a column does not vary."""
    if not pairs:
        return _empty(t)
    row = t.df.agg(*[correlation(t.number(a), t.number(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    )
    long = row.select(F.explode(cells).alias("s")).select("s.*")
    return _labelled(long, group, "pearson", F.col("a"), F.col("b"), F.col("r"))


def spearman(
    t: Table, pairs: list[tuple[str, str]], group: str = "Features", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Rank correlation of numeric pairs, ties sharing their mean rank; two shuffles for any number of columns."""
    if not pairs:
        return _empty(t)
    return _labelled(rank_correlation(t, pairs, rows_per_range), group, "spearman", F.col("a"), F.col("b"), F.col("value"))


def first_appearance_codes(t: Table, column: str, order: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(level, code): levels numbered by the smallest row key they occur at."""
    firsts = t.df.groupBy(c(column).alias("level")).agg(F.min(c(order)).alias("__f"))
    placed = running_total(firsts, ["__f", "level"], out="code", rows_per_range=rows_per_range)
    return placed.select("level", F.col("code").cast("bigint").alias("code"))


def column_types(t: Table) -> DataFrame:
    """(position, name, type, is_target) from the schema; blanks are stripped from names."""
    names = [*t.features, *([t.label] if t.label else [])]
    rows = [
        (i, n.strip(), "numerical" if is_numeric(t.dtype(n)) else "categorical", int(n == t.label)) for i, n in enumerate(names)
    ]
    return t.df.sparkSession.createDataFrame(rows, "position int, name string, type string, is_target int")


def column_statistics(t: Table) -> DataFrame:
    """Every statistic on every fitting column or pair, for features, label, and feature-label pairs."""
    numeric, categorical = t.numeric, t.categorical
    parts = [
        numeric_statistics(t, numeric),
        missing_values(t, list(t.features)),
        entropy(t, categorical),
        mutual_information(t, list(itertools.combinations(categorical, 2))),
        pearson(t, list(itertools.combinations(numeric, 2))),
        spearman(t, list(itertools.combinations(numeric, 2))),
    ]
    if t.label:
        parts.append(missing_values(t, [t.label], "Labels"))
        if is_numeric(t.dtype(t.label)):
            parts.append(numeric_statistics(t, [t.label], "Labels"))
            parts += [f(t, [(n, t.label) for n in numeric], "FeaturesLabels") for f in (pearson, spearman)]
        else:
            parts.append(entropy(t, [t.label], "Labels"))
            parts.append(mutual_information(t, [(n, t.label) for n in categorical], "FeaturesLabels"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SUMMARIES = {"mean": F.avg, "std": F.stddev_pop, "kurtosis": F.kurtosis, "skew": F.skewness}


def summarise(stats: DataFrame) -> DataFrame:
    """(name, value): ``group.function.summary``; one value stays as it is, two or more are aggregated."""
    per = stats.groupBy("grp", "mf").agg(
        F.count("*").alias("n"), F.first("value").alias("only"), *[fn("value").alias(k) for k, fn in SUMMARIES.items()]
    )
    cells = [F.struct(F.lit("non_aggregated").alias("pp"), F.col("only").alias("value"), (F.col("n") == 1).alias("ok"))]
    cells += [F.struct(F.lit(k).alias("pp"), F.col(k).alias("value"), (F.col("n") >= 2).alias("ok")) for k in SUMMARIES]
    long = per.select("grp", "mf", F.explode(F.array(*cells)).alias("s")).where("s.ok")
    return long.select(F.concat_ws(".", "grp", "mf", "s.pp").alias("name"), F.col("s.value").alias("value"))

