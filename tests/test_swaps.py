import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom import Table
from tabloom.operators.cluster import balanced_swaps
from tests.helpers import blobs


@pytest.mark.parametrize("rows_per_range", [1_000_000, 50])
def test_swaps_keep_sizes_and_lower_inertia(spark, rows_per_range):
    t, x, _ = blobs(spark, n=200, p=2, classes=3)
    t = Table.of(t.df.drop("y"), "id", None, ["f0", "f1"])
    centres = np.array([x[i] for i in (0, 70, 140)])
    gaps = ((x[:, None] - centres) ** 2).sum(axis=2)
    start = t.df.select("id", (F.col("id") % 3).cast("int").alias("cluster"))
    inertia = [gaps[np.arange(200), np.arange(200) % 3].sum()]
    sizes = np.bincount(np.arange(200) % 3)
    for rounds in (1, 4):
        out = balanced_swaps(t, start, centres, rounds, rows_per_range).orderBy("id").toPandas()
        assert list(out["id"]) == list(range(200))
        assert (np.bincount(out["cluster"], minlength=3) == sizes).all()
        inertia.append(gaps[np.arange(200), out["cluster"]].sum())
    assert inertia[0] > inertia[1] >= inertia[2]
