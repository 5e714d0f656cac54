"""Dataset meta-features as a long table (name, value).

All counts share one aggregate, classes and levels take one group-by each, and
only the landmarks train anything.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, functions as F

from tabloom.frame import CLASSIFICATION, Table, c
from tabloom.functions.linear import affine
from tabloom.functions.stats import class_index, classes, correlation, level_counts, moments, one_row
from tabloom.operators.base import get_operator
from tabloom.operators.decompose import principal_axes
from tabloom.operators.prepare import ImputeLabelEncode
from tabloom.operators.scale import StandardScale
from tabloom.plans.metrics import evaluate
from tabloom.sources.splits import stratified_kfold

EMPTY_VALUE = -99.0

COUNTS = (
    "NumberOfInstances LogNumberOfInstances NumberOfFeatures LogNumberOfFeatures "
    "NumberOfInstancesWithMissingValues PercentageOfInstancesWithMissingValues "
    "NumberOfFeaturesWithMissingValues PercentageOfFeaturesWithMissingValues "
    "NumberOfMissingValues PercentageOfMissingValues NumberOfNumericFeatures NumberOfCategoricalFeatures "
    "RatioNumericalToNominal RatioNominalToNumerical DatasetRatio LogDatasetRatio "
    "InverseDatasetRatio LogInverseDatasetRatio"
).split()
CLASSES = (
    "NumberOfClasses ClassProbabilityMin ClassProbabilityMax ClassProbabilityMean ClassProbabilitySTD ClassEntropy"
).split()
SYMBOLS = "SymbolsMin SymbolsMax SymbolsMean SymbolsSTD SymbolsSum".split()
SHAPES = [f"{s}{a}" for s in ("Kurtosis", "Skewness") for a in ("Min", "Max", "Mean", "STD")]
PCA = ["PCAFractionOfComponentsFor95PercentVariance", "PCAKurtosisFirstPC", "PCASkewnessFirstPC"]
CORRELATIONS = ["CorrelationMean", "CorrelationSTD"]
LANDMARKS = {
    "LandmarkLDA": ("clf_lda", {}),
    "LandmarkNaiveBayes": ("clf_gaussian_nb", {}),
    "LandmarkDecisionTree": ("clf_decision_tree", {"seed": 42}),
    "LandmarkDecisionNodeLearner": ("clf_decision_tree", {"impurity": "entropy", "depth": 1}),
    "LandmarkRandomNodeLearner": ("clf_decision_tree", {"impurity": "entropy", "depth": 1}),
    "Landmark1NN": ("clf_knn", {"k": 1}),
}
ALL = (*COUNTS, *CLASSES, *SYMBOLS, *SHAPES, *PCA, *LANDMARKS, *CORRELATIONS)
# What the default vector leaves out, as costly or unstable.
EXPENSIVE = ("Landmark1NN", "LandmarkDecisionNodeLearner", "LandmarkLDA")
REGRESSION_ONLY_WITHOUT = (*CLASSES, *LANDMARKS)

# Published subsets (Pfahringer et al. 2000; Yogatama & Mann 2014; Bardenet et al. 2013).
SUBSETS = {
    "all": ALL,
    "pfahringer_2000": (
        "NumberOfFeatures NumberOfNumericFeatures NumberOfCategoricalFeatures NumberOfClasses "
        "ClassProbabilityMax LandmarkLDA LandmarkNaiveBayes LandmarkDecisionTree"
    ).split(),
    "yogatama_2014": "LogNumberOfFeatures LogNumberOfInstances NumberOfClasses".split(),
    "bardenet_2013_boost": (
        "NumberOfClasses LogNumberOfFeatures LogInverseDatasetRatio PCAFractionOfComponentsFor95PercentVariance"
    ).split(),
    "bardenet_2013_nn": (
        "NumberOfClasses LogNumberOfFeatures LogInverseDatasetRatio PCAKurtosisFirstPC PCASkewnessFirstPC"
    ).split(),
}


def _log(x: float) -> float:
    return math.log(x) if x > 0 else float("-inf")


def count_features(t: Table) -> dict[str, float]:
    gaps = {n: t.number(n).isNull() | (F.abs(t.number(n)) == float("inf")) for n in t.numeric}
    aggs = {"rows": F.count("*"), **{f"g:{n}": F.sum(g.cast("bigint")) for n, g in gaps.items()}}
    if gaps:
        hit = None
        for g in gaps.values():
            hit = g if hit is None else hit | g
        aggs["bad"] = F.sum(hit.cast("bigint"))
    row = one_row(t.df, aggs)
    n, p = row["rows"], len(t.features)
    numeric, nominal = len(t.numeric), len(t.categorical)
    cells = sum(row[f"g:{name}"] or 0 for name in t.numeric)
    columns = sum(1 for name in t.numeric if row[f"g:{name}"])
    bad = row.get("bad") or 0
    ratio = p / n
    inverse = n / (p + 1e-7)
    return {
        "NumberOfInstances": n,
        "LogNumberOfInstances": _log(n),
        "NumberOfFeatures": p,
        "LogNumberOfFeatures": _log(p),
        "NumberOfInstancesWithMissingValues": bad,
        "PercentageOfInstancesWithMissingValues": bad / n,
        "NumberOfFeaturesWithMissingValues": columns,
        "PercentageOfFeaturesWithMissingValues": columns / p,
        "NumberOfMissingValues": cells,
        "PercentageOfMissingValues": cells / (n * p),
        "NumberOfNumericFeatures": numeric,
        "NumberOfCategoricalFeatures": nominal,
        "RatioNumericalToNominal": numeric / nominal if nominal else 0.0,
        "RatioNominalToNumerical": nominal / numeric if numeric else 0.0,
        "DatasetRatio": ratio,
        "LogDatasetRatio": _log(ratio),
        "InverseDatasetRatio": inverse,
        "LogInverseDatasetRatio": _log(inverse),
    }


def class_occurrences(t: Table) -> DataFrame:
    """(class, n): the class histogram."""
    return t.df.groupBy(c(t.label).alias("class")).agg(F.count("*").alias("n"))


def class_features(t: Table) -> dict[str, float]:
    """Shares are aggregated in Spark: a near-continuous target may have many classes."""
    counts = class_occurrences(t)
    rows = t.df.count()
    share = F.col("n") / F.lit(rows)
    row = counts.agg(
        F.count("*").alias("k"),
        F.min(share).alias("lo"),
        F.max(share).alias("hi"),
        F.avg(share).alias("mean"),
        F.stddev_pop(share).alias("sd"),
        (-F.sum(share * F.log2(share))).alias("h"),
    ).first()
    return dict(zip(CLASSES, (row["k"], row["lo"], row["hi"], row["mean"], row["sd"], row["h"])))


def num_symbols(t: Table) -> DataFrame:
    """(feature, symbols): distinct levels per categorical column, missing counted as one."""
    return level_counts(t, t.categorical).groupBy("feature").agg(F.count("*").alias("symbols"))


def symbol_features(t: Table) -> dict[str, float]:
    if not t.categorical:
        return dict.fromkeys(SYMBOLS, 0.0)
    row = num_symbols(t).agg(
        F.min("symbols"), F.max("symbols"), F.avg("symbols"), F.stddev_pop("symbols"), F.sum("symbols")
    ).first()
    return dict(zip(SYMBOLS, row))


def shape_table(coded: Table) -> DataFrame:
    """(feature, kurtosis, skewness) of imputed, coded columns; undefined moments count 0."""
    cells = []
    for i, n in enumerate(coded.features):
        cells += [F.kurtosis(coded.number(n)).alias(f"k{i}"), F.skewness(coded.number(n)).alias(f"s{i}")]
    row = coded.df.agg(*cells)
    both = [
        F.struct(
            F.lit(n).alias("feature"),
            F.coalesce(F.nanvl(F.col(f"k{i}"), F.lit(0.0)), F.lit(0.0)).alias("kurtosis"),
            F.coalesce(F.nanvl(F.col(f"s{i}"), F.lit(0.0)), F.lit(0.0)).alias("skewness"),
        )
        for i, n in enumerate(coded.features)
    ]
    return row.select(F.explode(F.array(*both)).alias("r")).select("r.*")


def shape_features(coded: Table) -> dict[str, float]:
    aggs = []
    for col in ("kurtosis", "skewness"):
        aggs += [F.min(col), F.max(col), F.avg(col), F.stddev_pop(col)]
    return dict(zip(SHAPES, shape_table(coded).agg(*aggs).first()))


def pca_features(scaled: Table) -> dict[str, float]:
    m = moments(scaled)
    variance, axes = principal_axes(m)
    share = np.cumsum(variance) / (variance.sum() or 1.0)
    wanted = int(np.searchsorted(share, 0.95 - 1e-12) + 1)
    x = [scaled.number(n) - F.lit(float(v)) for n, v in zip(scaled.features, m.mean)]
    first = scaled.df.select(affine(x, axes[:1], np.zeros(1))[0].alias("s"))
    row = first.agg(F.kurtosis("s"), F.skewness("s")).first()
    return dict(zip(PCA, (wanted / len(scaled.features), row[0], row[1])))


def correlation_features(t: Table, coded: Table, least: int = 50) -> dict[str, float]:
    """Mean and spread over features of the correlation with the class index.

    Pairs with a missing value are left out; fewer than ``least`` pairs give 0.
    """
    y = (
        class_index(coded, classes(t)).cast("double")
        if t.task == CLASSIFICATION
        else coded.number(t.label)
    )
    aggs = {}
    for n in coded.features:
        aggs[f"r:{n}"] = correlation(coded.number(n), y)
        aggs[f"n:{n}"] = F.sum((coded.number(n).isNotNull() & y.isNotNull()).cast("bigint"))
    row = one_row(coded.df, aggs)
    values = []
    for n in coded.features:
        r = row[f"r:{n}"]
        usable = r is not None and not math.isnan(r) and row[f"n:{n}"] >= least
        values.append(r if usable else 0.0)
    return dict(zip(CORRELATIONS, (float(np.mean(values)), float(np.std(values)))))


def landmark(name: str, scaled: Table, folds: int = 2) -> float:
    """Mean accuracy over stratified folds; NaN when the learner cannot be fitted."""
    op, params = LANDMARKS[name]
    t = scaled
    if name == "LandmarkRandomNodeLearner":
        t = scaled.pick([scaled.features[int(np.random.default_rng(42).integers(len(scaled.features)))]])
    folded = stratified_kfold(t, folds)
    rows = folded.df.persist()
    try:
        total = 0.0
        for i in range(folds):
            part = folded.with_df(rows)
            fitted = get_operator(op, **params).fit(part.where(F.col("fold") != i))
            total += evaluate("accuracy", fitted.transform(part.where(F.col("fold") == i)))
        return total / folds
    except (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException):  # it cannot be fitted
        return float("nan")
    finally:
        rows.unpersist()


def raw_coded(t: Table) -> Table:
    """Numbers as they are, gaps included, and categorical columns as level codes."""
    fitted = get_operator("label_encode", keep_numeric=True).fit(t)
    return fitted.transform(t) if t.categorical else t.derive({n: t.number(n) for n in t.features})


def prepared(t: Table) -> Table:
    """Level codes and mean-imputed numbers."""
    return ImputeLabelEncode().fit_transform(t)


def metafeature_values(t: Table, names: Iterable[str] = ALL) -> dict[str, float]:
    wanted = [n for n in ALL if n in set(names)]
    if not t.features or not t.df.take(1):
        return dict.fromkeys(wanted, EMPTY_VALUE)
    if t.task != CLASSIFICATION:
        wanted = [n for n in wanted if n not in REGRESSION_ONLY_WITHOUT]
    groups: list[tuple[Iterable[str], Callable[[], dict[str, float]]]] = [
        (COUNTS, lambda: count_features(t)),
        (CLASSES, lambda: class_features(t)),
        (SYMBOLS, lambda: symbol_features(t)),
        (CORRELATIONS, lambda: correlation_features(t, raw_coded(t))),
    ]
    values: dict[str, float] = {}
    for group, compute in groups:
        if set(group) & set(wanted):
            values |= compute()
    second = set(SHAPES) | set(PCA) | set(LANDMARKS)
    if second & set(wanted):
        coded = prepared(t)
        if set(SHAPES) & set(wanted):
            values |= shape_features(coded)
        if (set(PCA) | set(LANDMARKS)) & set(wanted):
            scaled = StandardScale().fit_transform(coded)
            if set(PCA) & set(wanted):
                values |= pca_features(scaled)
            for n in LANDMARKS:
                if n in wanted:
                    values[n] = landmark(n, scaled)
    return {n: float(values[n]) if values[n] is not None else float("nan") for n in wanted}


def metafeature_profile(
    t: Table, calculate: Iterable[str] | None = None, dont_calculate: Iterable[str] = EXPENSIVE
) -> DataFrame:
    """(name, value) of the chosen meta-features; an empty table gives -99 throughout."""
    skip = set(dont_calculate) - set(calculate or ())
    names = [n for n in (calculate or ALL) if n not in skip]
    rows = list(metafeature_values(t, names).items())
    return t.df.sparkSession.createDataFrame(rows, "name string, value double")

