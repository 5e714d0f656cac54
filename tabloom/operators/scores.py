"""Univariate feature scores: one row (feature, score, p_value) per feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tabloom.frame import Table, c
from tabloom.functions.pvalues import chi2_p, f_p
from tabloom.functions.stats import PERFECT, correlation, unpivot
from tabloom.operators.information import neighbour_information
from tabloom.operators.scale import bin_edges, bin_of


def _per_class(t: Table, aggregates) -> DataFrame:
    """(y, n, feature, struct of aggregates): grouped once, then unpivoted while tiny."""
    cells, names = [], {}
    for i, n in enumerate(t.features):
        for key, fn in aggregates.items():
            cells.append(fn(t.number(n)).alias(f"{key}{i}"))
        names[n] = F.struct(*[F.col(f"{key}{i}").alias(key) for key in aggregates])
    grouped = t.df.where(c(t.label).isNotNull()).groupBy(c(t.label).alias("y")).agg(F.count("*").alias("n"), *cells)
    long = unpivot(grouped, names, {"y": F.col("y"), "n": F.col("n")})
    return long.select("y", "n", "feature", *[F.col(f"value.{k}").alias(k) for k in aggregates])


def score_chi2(t: Table) -> DataFrame:
    """Observed and expected sums of a non-negative feature per class."""
    w = W.partitionBy("feature")
    cells = _per_class(t, {"s": F.sum}).select(
        "feature", "s", (F.col("n") / F.sum("n").over(w) * F.sum("s").over(w)).alias("e")
    )
    gap = F.col("s") - F.col("e")
    return (
        cells.groupBy("feature")
        .agg(F.sum(F.when(F.col("e") != 0, gap * gap / F.col("e"))).alias("score"), (F.count("*") - 1).alias("df"))
        .select("feature", "score", chi2_p(F.col("score"), F.col("df")).alias("p_value"))
    )


def score_f_classif(t: Table) -> DataFrame:
    """One-way analysis of variance from per-class counts, means and variances."""
    w = W.partitionBy("feature")
    cells = _per_class(t, {"m": F.avg, "v": F.var_pop}).select(
        "feature", "n", "m", "v", (F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)).alias("g")
    )
    gap = F.col("m") - F.col("g")
    sums = cells.groupBy("feature").agg(
        F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.count("*") - 1).alias("d1"),
        (F.sum("n") - F.count("*")).alias("d2"),
    )
    # no spread within the classes: infinite if their means differ, undefined if they do not
    ratio = F.when(F.col("within") > 0, (F.col("between") / F.nullif(F.col("d1"), F.lit(0))) / F.nullif(F.col("within") / F.nullif(F.col("d2"), F.lit(0)), F.lit(0.0)))
    ratio = ratio.when(F.col("between") > 0, F.lit(float("inf")))
    return sums.select("feature", ratio.alias("score"), "d1", "d2").select(
        "feature", "score", f_p(F.col("score"), F.col("d1"), F.col("d2")).alias("p_value")
    )


def score_f_regression(t: Table) -> DataFrame:
    """F of the simple regression on each feature, from its correlation."""
    y = t.number(t.label)
    row = t.df.agg(
        F.count("*").alias("n"), *[correlation(t.number(n), y).alias(f"r{i}") for i, n in enumerate(t.features)]
    )
    long = unpivot(row, {n: F.col(f"r{i}") for i, n in enumerate(t.features)}, {"n": F.col("n")})
    r2 = F.col("value") * F.col("value")
    score = F.when(r2 >= 1 - PERFECT, F.lit(float("inf"))).when(r2 < 1, r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2))
    scored = long.select("feature", score.alias("score"), (F.col("n") - 2).alias("d2"))
    return scored.select("feature", "score", f_p(F.col("score"), F.lit(1), F.col("d2")).alias("p_value"))


def _mutual_information(cells: DataFrame) -> DataFrame:
    """Natural-log MI of (b, y) per feature from contingency counts."""
    by_f = W.partitionBy("feature")
    cells = cells.withColumn("n", F.col("n").cast("double"))  # products of counts pass the range of a long
    n, total = F.col("n"), F.sum("n").over(by_f)
    rows, cols = F.sum("n").over(W.partitionBy("feature", "b")), F.sum("n").over(W.partitionBy("feature", "y"))
    terms = cells.select("feature", (n / total * F.log(n * total / (rows * cols))).alias("t"))
    return terms.groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("score")).select(
        "feature", "score", F.lit(None).cast("double").alias("p_value")
    )


def score_mutual_info_classif(t: Table, bins: int = 10, estimator: str = "bins", neighbours: int = 3) -> DataFrame:
    """MI of quantile bins and classes, or, by name, the nearest-neighbour estimate of continuous features and classes."""
    if estimator == "neighbours":
        return neighbour_information(t, neighbours)
    if estimator != "bins":
        raise ValueError(f"no such estimator: {estimator}")
    edges = bin_edges(t, t.features, bins)
    cells = (
        unpivot(t.df, {n: bin_of(t.number(n), edges[n]) for n in t.features}, {"y": c(t.label)})
        .where("value is not null and y is not null")
        .groupBy("feature", F.col("value").alias("b"), "y")
        .agg(F.count("*").alias("n"))
    )
    return _mutual_information(cells)


def score_mutual_info_regression(t: Table, bins: int = 10) -> DataFrame:
    """MI of quantile bins of the feature and of the target."""
    target = Table(t.df, t.key, None, (t.label,))
    cut = bin_edges(target, [t.label], bins)[t.label]
    binned = t.derive({**{n: c(n) for n in t.features if n != t.label}, "__y": bin_of(t.number(t.label), cut)})
    names = [n for n in t.features]
    with_bins = Table(binned.df, t.key, "__y", tuple(names))
    return score_mutual_info_classif(with_bins, bins)


SCORES = {
    "chi2": score_chi2,
    "f_classif": score_f_classif,
    "f_regression": score_f_regression,
    "mi_classif": score_mutual_info_classif,
    "mi_regression": score_mutual_info_regression,
}
