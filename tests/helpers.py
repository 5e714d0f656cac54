"""Small frames with known shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tabloom import Table
from tabloom.frame import CLASSIFICATION


def table(spark, rows, schema, key="id", label=None, features=None, task=CLASSIFICATION) -> Table:
    return Table.of(spark.createDataFrame(rows, schema), key, label, features, task)


def blobs(spark, n=300, p=3, classes=3, gap=4.0, seed=0, partitions=4) -> tuple[Table, np.ndarray, np.ndarray]:
    """Well separated classes a, b, c."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.standard_normal((n, p)) + gap * rng.standard_normal((classes, p))[y]
    pdf = pd.DataFrame({f"f{i}": x[:, i] for i in range(p)})
    pdf.insert(0, "id", np.arange(n))
    pdf.insert(1, "y", [chr(97 + v) for v in y])
    df = spark.createDataFrame(pdf).repartition(partitions)
    return Table.of(df, "id", "y", task=CLASSIFICATION), x, np.array([chr(97 + v) for v in y])


def collect(df, *order):
    return df.orderBy(*order).toPandas()
