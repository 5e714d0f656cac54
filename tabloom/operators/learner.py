"""What all learners share: class levels, output columns, label indexing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, functions as F

from tabloom.frame import CLASSIFICATION, REGRESSION, Table, c
from tabloom.functions.linear import first_max
from tabloom.operators.base import Operator


def roles_of(t: Table) -> list[str]:
    """Columns that stay beside a new prediction (an earlier one is replaced)."""
    return replace(t, prediction=None).roles


class Classifier(Operator):
    """Emits ``prediction`` and one ``{class}_{title}Pred`` column per class."""

    family = "Classifier"
    contract = "c"
    title = "Classifier"

    def outputs(self, t: Table, labels: Sequence, probabilities: Sequence[Column], prediction: Column | None = None) -> Table:
        names = [f"{v}_{self.title}Pred" for v in labels]
        kept = [c(n) for n in roles_of(t)]
        own = [prediction.alias("prediction")] if prediction is not None else []
        df = t.df.select(*kept, F.array(*probabilities).alias("__p"), *own)
        p = [F.get("__p", F.lit(i)) for i in range(len(labels))]
        chosen = F.col("prediction") if prediction is not None else first_max(p, labels)
        df = df.select(*kept, chosen.alias("prediction"), *[v.alias(n) for n, v in zip(names, p)])
        return replace(t, df=df, features=tuple(names), prediction="prediction", task=CLASSIFICATION)

    def one_hot_outputs(self, t: Table, labels: Sequence, prediction: Column) -> Table:
        """For learners without probabilities: 1 for the predicted class, else 0."""
        flags = [F.when(prediction == F.lit(v), 1.0).otherwise(0.0) for v in labels]
        return self.outputs(t, labels, flags, prediction)


class Regressor(Operator):
    family = "Regressor"
    contract = "c_r"
    title = "Regressor"

    def outputs(self, t: Table, prediction: Column) -> Table:
        df = t.df.select(*[c(k) for k in roles_of(t)], prediction.alias("prediction"))
        df = df.withColumn(f"{self.title}Pred", F.col("prediction"))
        return replace(t, df=df, features=(f"{self.title}Pred",), prediction="prediction", task=REGRESSION)
