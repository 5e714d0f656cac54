"""Scores of predictions, each one aggregate."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabloom.frame import Table, c
from tabloom.sources.splits import kfold


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((c(truth) == c(predicted)).cast("int")).alias("accuracy"))


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean over all true or predicted classes of (sensitivity + specificity) / 2.

    A class that never occurs as truth scores 0; with a single true class the
    specificity is undefined and the result null. Only confusion counts
    (classes squared) go past the first aggregate.
    """
    cells = df.groupBy(c(truth).cast("string").alias("y"), c(predicted).cast("string").alias("p")).agg(
        F.count("*").alias("n")
    )
    sides = F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("q"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("q"), F.lit(0).cast("bigint").alias("hit")),
    )
    per_class = cells.select(F.explode(sides).alias("s")).groupBy("s.cls").agg(
        F.sum("s.t").alias("t"), F.sum("s.q").alias("q"), F.sum("s.hit").alias("hit")
    )
    # One row per class from here on; a window over them carries the grand total.
    everywhere = W.partitionBy(F.lit(0))
    none = F.lit(0).cast("bigint")
    totalled = per_class.withColumn("all", F.sum("t").over(everywhere))
    rest = F.col("all") - F.col("t")
    specificity = (rest - (F.col("q") - F.col("hit"))) / F.nullif(rest, none)
    score = F.when(F.col("t") == 0, 0.0).otherwise((F.col("hit") / F.nullif(F.col("t"), none) + specificity) / 2)
    undefined = F.max((F.col("t") == F.col("all")).cast("int")) == 1
    return totalled.agg(F.when(undefined, F.lit(None).cast("double")).otherwise(F.avg(score)).alias("balanced_accuracy"))


def mean_squared_error(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    gap: Column = c(truth) - c(predicted)
    return df.agg(F.avg(gap * gap).alias("mse"))


METRICS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "accuracy": accuracy,
    "balanced_accuracy": balanced_accuracy,
    "mse": mean_squared_error,
}


def evaluate(metric: str, t: Table) -> float | None:
    return METRICS[metric](t.df, t.label, t.prediction).first()[0]


def fold_scores(t: Table, fit: Callable[[Table], object], metric: str, k: int = 5) -> list[dict]:
    """Score of every contiguous fold; a failing fold keeps its message instead of a score."""
    folded = kfold(t, k)
    rows = []
    for i in range(k):
        try:
            fitted = fit(folded.where(F.col("fold") != i))
            score = evaluate(metric, fitted.transform(folded.where(F.col("fold") == i)))
            rows.append({"fold": i, "score": score, "message": None})
        except Exception as error:  # noqa: BLE001 - recorded, not hidden
            rows.append({"fold": i, "score": None, "message": str(error)[:500]})
    return rows


def cross_validate(t: Table, fit: Callable[[Table], object], metric: str, k: int = 5) -> float | None:
    """Mean score over the folds that could be scored; a warning names those that could not."""
    rows = fold_scores(t, fit, metric, k)
    scores = [r["score"] for r in rows if r["score"] is not None]
    if len(scores) < k:
        lost = [f"{r['fold']}: {r['message'] or 'no score'}" for r in rows if r["score"] is None]
        warnings.warn(f"mean over {len(scores)} of {k} folds; without {'; '.join(lost)}", stacklevel=2)
    return sum(scores) / len(scores) if scores else None
