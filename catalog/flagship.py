"""The smoke query: clean, scale, learn, score."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import gappy_lines, rounded
from tabloom import get_operator
from tabloom.plans.metrics import METRICS
from tabloom.sources.splits import train_test_split


def flagship(spark, sf):
    t = gappy_lines(spark, sf, ["qty", "price", "disc", "tax"], "l_returnflag")
    train, test = train_test_split(t)
    for name in ("impute_mean", "standard_scale", "clf_gaussian_nb"):
        fitted = get_operator(name).fit(train)
        train, test = fitted.transform(train), fitted.transform(test)
    scores = [
        METRICS[name](test.df, test.label, test.prediction).select(F.lit(name).alias("metric"), F.col(name).alias("value"))
        for name in ("accuracy", "balanced_accuracy")
    ]
    return rounded(scores[0].unionByName(scores[1]))
