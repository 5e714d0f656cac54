import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import vectors as vectors_module
from tabloom.llm.hard_negatives import hard_negatives, likely, op12_hard_negatives

KINDS = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives=10):
    """The contract by all pairs; rows are (vec_id, embedding, label)."""
    whole = [
        (v, [math.floor(256 * x) for x in e], y) for v, e, y in rows
        if v is not None and y is not None and e and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for k, (v, e, y) in enumerate(whole):
        if not anchor(v):
            continue
        scored = [(-sum(a * b for a, b in zip(e, f)), w, z) for j, (w, f, z) in enumerate(whole) if j != k and len(f) == len(e)]
        for s, p, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            near = sorted(x for x in scored if x[2] != y and -30 * s <= -100 * x[0] <= -90 * s)[:negatives]
            out += [(v, p, r, n, -s, -t) for r, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


def rows_of(spark, sf):
    found = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    return [(r.vec_id, [float(x) for x in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in found]


def test_query_against_all_pairs(spark, sf):
    want = brute(rows_of(spark, sf), lambda v: v % 100 == 0)
    assert want and result(op12_hard_negatives(spark, sf)) == want


@pytest.mark.parametrize("seed,bytes_", [(0, 32_000_000), (1, 2_000)])
def test_ties_repeated_rows_and_many_slices(spark, monkeypatch, seed, bytes_):
    monkeypatch.setattr(vectors_module, "SLICE_BYTES", bytes_)
    monkeypatch.setattr(vectors_module, "ROWS_IN_BLOCK", 7)
    monkeypatch.setattr(vectors_module, "QUERIES_IN_BLOCK", 3)
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, 60)), (rng.integers(-2, 3, 3) / 16).tolist(), int(rng.integers(0, 3))) for _ in range(260)]
    rows += rows[:40]
    got = hard_negatives(spark.createDataFrame(rows, KINDS).repartition(5), F.col("vec_id") % 4 == 0)
    assert result(got) == brute(rows, lambda v: v % 4 == 0)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 1.0], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (7, [], 2),
            (None, [0.5, 0.0], 2), (8, [0.5, 0.0], None), (9, [0.5], 2), (200, [0.0, 0.0], 3), (10, [0.0, 0.0], 3), (11, [0.0, 5.0], 1), (300, [-1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, KINDS)
    for name in ("row", "slice", "width", "anchor", "score", "my col", "a.b"):
        frame = frame.withColumn(name, F.lit("x"))
    want = brute(rows, lambda v: v % 100 == 0)
    assert want and result(hard_negatives(frame, F.col("vec_id") % 100 == 0)) == want
    assert hard_negatives(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    # products beyond doubles and beyond 64 bits
    big = [(100, [1e6, 3.0], 1), (1, [1e6 + 1, 2.0], 1), (2, [5e5, 1.0], 2), (3, [6e5 + 3, 7.0], 2)]
    assert result(hard_negatives(spark.createDataFrame(big, KINDS), F.col("vec_id") == 100)) == brute(big, lambda v: v == 100)
    far = spark.createDataFrame([(100, [1e30], 1), (1, [1e30], 1), (2, [1e-2], 2)], KINDS)
    assert hard_negatives(far, F.col("vec_id") == 100).count() == 0


def test_likely_keeps_the_first_of_each_row():
    rng = np.random.default_rng(0)
    score, allowed = rng.integers(-5, 5, (30, 40)), rng.random((30, 40)) < 0.3
    kept = likely(score, allowed, 4)
    for s, a, k in zip(score, allowed, kept):
        best = sorted(s[a])[::-1][:4]
        assert not (k & ~a).any() and (s[k].min(initial=99) == best[-1] if best else not k.any())
