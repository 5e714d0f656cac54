import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom import Table, get_operator
from tabloom.frame import CLASSIFICATION
from tabloom.operators.base import Fitted
from tabloom.operators.bootstrap import balanced_bootstrap
from tabloom.operators import grow
from tabloom.operators.grow import Grower, Rule, Tree
from tests.helpers import blobs


def rows_of(spark, x, y, w=None, partitions=3):
    data = [(v.tolist(), int(k)) if w is None else (v.tolist(), int(k), c.tolist()) for v, k, c in zip(x, y, w if w is not None else y)]
    kinds = "x array<double>, y int" + (", w array<int>" if w is not None else "")
    return spark.createDataFrame(data, kinds).repartition(partitions)


def checked(tree, x, y, w, k):
    """Every node's counts are those of the rows that pass it; leaves are pure or cannot be cut."""
    nodes = {0: np.flatnonzero(w > 0)}
    for i in range(len(tree.feature)):
        rows = nodes[i]
        assert tree.value[i] == np.bincount(y[rows], weights=w[rows], minlength=k).tolist()
        if tree.feature[i] >= 0:
            goes = x[rows, tree.feature[i]] > tree.cut[i]
            assert goes.any() and not goes.all()
            nodes[tree.left[i]], nodes[tree.right[i]] = rows[~goes], rows[goes]
        else:
            assert len(set(y[rows])) < 2 or all(len(set(c)) == 1 for c in x[rows].T)
    return len(nodes)


@pytest.mark.parametrize("random", [True, False])
@pytest.mark.parametrize("local", [10**6, 60, 0])
def test_trees_hold_their_rows(spark, random, local):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 4)), 1)
    x[:, 3] = 7.0
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int) + (x[:, 1] > 1)
    w = rng.integers(0, 3, (300, 3))
    forest = Grower(rows_of(spark, x, y, w), 3, Rule(3, 4, 2, 5, random, 64), local).run()
    for tree, own in zip(forest, w.T, strict=True):
        if random or local:
            assert checked(tree, x, y, own, 3) > 20
        end = tree.route(x)
        assert all(tree.feature[i] < 0 for i in end)


def test_partitions_and_phases_do_not_matter(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200)
    found = [
        [vars(t) for t in Grower(rows_of(spark, x, y, partitions=n), 2, Rule(2, 3, 1, 9, True, 5), local).run()]
        for n, local in ((1, 1000), (5, 1000), (4, 30), (2, 30))
    ]
    assert found[0] == found[1] and found[2] == found[3]


def test_grafts_and_routes():
    a, b = Tree(value=[[4.0]]), Tree(value=[[3.0]])
    left, right = a.split(0, 0, 1.0, ([1.0], [3.0]))
    b.split(0, 1, 0.5, ([1.0], [2.0]))
    a.graft(right, b)
    x = np.array([[0.0, 9.0], [2.0, 0.0], [2.0, 1.0]])
    assert [a.value[i] for i in a.route(x)] == [[1.0], [1.0], [2.0]] and a.route(x)[0] == left
    assert a.route(np.zeros((0, 2))).tolist() == []


def accuracy(spark, name, pdf, **params):
    names = [n for n in pdf.columns if n not in ("id", "y")]
    t = Table.of(spark.createDataFrame(pdf).repartition(3), "id", "y", names, CLASSIFICATION)
    fitted = get_operator(name, **params).fit(t)
    out = fitted.transform(t)
    again = Fitted.from_json(fitted.to_json()).transform(t)
    a, b = (o.df.orderBy("id").toPandas() for o in (out, again))
    pd.testing.assert_frame_equal(a, b)
    assert np.allclose(a[list(out.features)].sum(axis=1), 1)
    return (a["prediction"] == a["y"]).mean()


@pytest.mark.parametrize("local", [20_000, 100])
def test_an_outlier_does_not_hide_a_separable_column(spark, local):
    """One value far out makes cuts over the whole range useless; cuts within nodes recover."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600)
    x = y + rng.uniform(-0.4, 0.4, 600)
    x[0] = 1e9
    pdf = pd.DataFrame({"id": range(600), "y": np.where(y > 0, "b", "a"), "x": x, "noise": rng.normal(size=600)})
    assert accuracy(spark, "clf_extra_trees", pdf, local_rows=local) >= 0.95


def test_balanced_forest_finds_a_rare_class(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(800) < 0.05).astype(int)
    pdf = pd.DataFrame({"id": range(800), "y": y, "x": y * 2 + rng.normal(size=800), "z": rng.normal(size=800)})
    assert accuracy(spark, "clf_balanced_random_forest", pdf, trees=20) > 0.7


@pytest.mark.parametrize("bucket", [10**6, 40])
def test_bootstraps_add_up_for_any_partitions(spark, bucket):
    t, _, y = blobs(spark, n=500, gap=1.0, seed=6)
    t = t.where(F.col("y").isin("a", "b") | (F.col("id") % 7 == 0))
    found = []
    for n in (1, 6):
        rows = balanced_bootstrap(t.with_df(t.df.repartition(n)), ["a", "b", "c", "never"], 5, 3, bucket).collect()
        assert len(rows) == t.df.count()
        found.append({r.id: (r.y, r.w) for r in rows})
    assert found[0] == found[1]
    sizes = [r["count"] for r in t.df.groupBy("y").count().collect()]
    totals = np.zeros((5, 4), int)
    for k, w in found[0].values():
        totals[:, k] += w
    assert (totals[:, :3] == min(sizes)).all() and (totals[:, 3] == 0).all()
    counts = np.array([w for _, w in found[0].values()])
    assert counts.max() > 1 and 0.2 < (counts == 0).mean() < 0.9  # with replacement
    assert balanced_bootstrap(t.with_df(t.df.limit(0)), ["a"], 2).count() == 0
    assert json.dumps(found[0][min(found[0])][1])


def test_embedding_needs_no_explode(spark):
    t, _, _ = blobs(spark, n=300, seed=8)
    fitted = get_operator("random_trees_embedding", trees=4, depth=3).fit(t)
    out = fitted.transform(t).df.toPandas()
    leaves = [n for n in out.columns if "rfembdng" in n]
    assert (out[leaves].sum(axis=1) == 4).all() and (out[leaves].sum(axis=0) > 0).all()
    assert fitted.state["leaves"] == sorted(fitted.state["leaves"])


@pytest.mark.parametrize("name", ["clf_extra_trees", "clf_balanced_random_forest"])
def test_a_large_forest_stays_off_the_driver(spark, monkeypatch, name):
    """Rows are scored where the subtrees are, to the same shares, and the driver keeps the tops only."""
    t, _, _ = blobs(spark, n=700, gap=0.7, seed=5)
    t = t.with_df(t.df.unionByName(t.df.where("id < 40")).repartition(5))  # keys that repeat
    if name == "clf_balanced_random_forest":
        t = t.where(F.col("id") >= 40)  # here the key must name one row
    params = {"trees": 6, "local_rows": 60}
    near = get_operator(name, **params).fit(t)
    monkeypatch.setattr(grow, "HELD_CELLS", 0)
    monkeypatch.setattr(grow, "CHUNK_BYTES", 3_000)
    monkeypatch.setattr(grow, "SLICE_BYTES", 24 * 200)
    far = get_operator(name, **params).fit(t)
    assert "rest" not in near.state and max(far.state["rest"]["chunk"]) > 2
    assert sum(len(v["feature"]) for v in far.state["forest"]) < 0.3 * sum(len(v["feature"]) for v in near.state["forest"])
    a, b = (f.transform(t).df.toPandas() for f in (near, Fitted.from_json(far.to_json())))
    columns = [n for n in a.columns if n.endswith("Pred")]
    a, b = (v.sort_values(["id", *columns], ignore_index=True) for v in (a, b))
    assert np.allclose(a[columns], b[columns]) and a[["id", "y"]].equals(b[["id", "y"]])
