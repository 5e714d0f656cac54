import math

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm.topk_search import op9_topk_search, search_block, top_k


def brute(rows, ask, k):
    """All pairs of rows; every row but the query's own is a candidate."""
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, asked) in enumerate(ok):
        if ask(q):
            found = sorted((-sum(a * b for a, b in zip(asked, v)), i) for n, (i, v) in enumerate(ok) if n != own and len(v) == len(asked))[:k]
            out += [(q, n, i, max(-(2**63) + 1, min(2**63 - 1, -s))) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_all_queries(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, op9_topk_search(spark, sf).collect()))
    assert got == brute(rows, lambda i: i % 20 == 0, 20)


def test_hard_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(300)]
    rows += [(400 + i, [0.5] * 20) for i in range(30)]  # ties
    rows += [(None, [1.0] * 20), (500, None), (520, []), (540, [float("nan")] * 20), (560, [float("inf")] + [0.0] * 19), (580, [None] * 20)]
    rows += [(600, [1e6] * 20), (601, [1e6] * 20), (620, [0.1, 0.2]), (621, [0.3, -0.2]), (20, rows[20][1]), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("q", "slice", "ids", "kind", "width")})
    got = sorted(map(tuple, top_k(frame, F.col("vec_id") % 20 == 0, k=7).collect()))
    assert got == brute(rows, lambda i: i % 20 == 0, 7)
    assert top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_keep_what_reaches_the_floor():
    rng = np.random.default_rng(5)
    q, c = np.floor(64 * rng.normal(size=(9, 64))), np.floor(64 * rng.normal(size=(64, 700)) * np.exp(-np.arange(64) / 8)[:, None])
    scores = q @ c
    floor = np.sort(scores, axis=1)[:, -5]
    a, b, s = search_block(q, c, floor)
    assert sorted(zip(a.tolist(), b.tolist(), s.tolist())) == sorted((i, j, scores[i, j]) for i in range(9) for j in range(700) if scores[i, j] >= floor[i])


def test_large_finite_components_are_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=40).tolist()) for i in range(200)]
    # sizes whose squares do not fit into 64 bits, alone among small vectors; mixed signs within one vector
    rows += [(301 + i, (rng.normal(size=40) * size).tolist()) for i, size in enumerate([5e7, 1e8, 1e8, 1e10, 1e13])]
    rows += [(320, (rng.normal(size=40) * 10).tolist()), (321, [1e13] + [0.0] * 39), (322, [0.0] * 39 + [-1e13])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for slices in (1, 5):
        got = sorted(map(tuple, top_k(frame, F.col("vec_id") % 20 == 0, k=7, slices_=slices).collect()))
        assert got == brute(rows, lambda i: i % 20 == 0, 7)


def test_bounds_of_integers_beyond_the_floats():
    rng = np.random.default_rng(6)
    for size_q, size_c, kind in ((1e2, 5e14, np.int64), (1e15, 1e15, object), (3e9, 1e7, np.int64)):
        q = np.floor(size_q * rng.normal(size=(5, 48))).astype(np.int64).astype(kind)
        c = np.floor(size_c * rng.normal(size=(48, 300)) * np.exp(-np.arange(48) / 6)[:, None]).astype(np.int64).astype(kind)
        scores = q.astype(object) @ c.astype(object)
        floor = np.sort(scores.astype(np.float64), axis=1)[:, -5]
        a, b, s = search_block(q, c, floor)
        want = sorted((i, j, scores[i, j]) for i in range(5) for j in range(300) if float(scores[i, j]) >= floor[i])
        assert sorted(zip(a.tolist(), b.tolist(), s.tolist())) == want


def test_components_beyond_64_bits_are_searched(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)] + [(40, [3e17, 0.0, 1.0]), (41, [1e16, 1.0, 0.0]), (60, [-2e16, 1.0, 2.0]), (61, [1e15, 5.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(frame, F.col("vec_id") % 20 == 0, k=5).collect())) == brute(rows, lambda i: i % 20 == 0, 5)
    # beyond 38 digits scores tie
    far = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [1e29]), (20, [-1e30])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in top_k(far, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2, 20]


def test_rows_move_once_and_queries_to_each_slice(spark):
    """The plan has no join that sends rows to blocks of queries: one exchange takes both."""
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, embedding array<double>")
    plan = top_k(frame, F.col("vec_id") % 20 == 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and plan.count("Join") == 2 and plan.count("RepartitionByExpression") == 1
