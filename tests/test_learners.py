import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom import Table, get_operator, operator_names
from tabloom.frame import REGRESSION, c
from tabloom.operators import neighbors
from tabloom.operators.ensemble import MajorityVote
from tabloom.operators.neighbors import nearest
from tabloom.plans.metrics import balanced_accuracy, evaluate
from tests.helpers import blobs, collect, table

FAST = {"clf_random_forest": {"depth": 5}, "clf_bagging": {"depth": 5}, "clf_decision_tree": {"depth": 5}}
FAST |= {n: {"rounds": 3} for n in ("clf_gradient_boosting", "clf_xgb", "clf_lightgbm")}
FAST |= {n: {"rounds": 12} for n in ("clf_adaboost", "clf_easy_ensemble", "clf_rusboost")}
FAST |= {"clf_extra_trees": {"trees": 3, "depth": 6}, "clf_balanced_random_forest": {"trees": 10, "depth": 5}}
FAST |= {"clf_svc_rbf": {"components": 40}, "clf_easy_ensemble": {"rounds": 12, "members": 3}}
NON_NEGATIVE = {"clf_multinomial_nb", "clf_complement_nb"}


@pytest.fixture(scope="module")
def three(spark):
    t, x, y = blobs(spark, n=240, seed=2)
    rows = t.df.cache()
    return t.with_df(rows), x, y


@pytest.mark.parametrize("name", operator_names("Classifier"))
def test_classifier_contract(spark, three, name):
    """Probabilities are shares, the prediction is a label, and easy classes are learned."""
    t, _, _ = three
    if name in NON_NEGATIVE:
        t = t.derive({n: F.exp(c(n)) for n in t.features})
    out = get_operator(name, **FAST.get(name, {})).fit_transform(t)
    rows = collect(out.df, "id")
    assert len(rows) == 240 and len(out.features) == 3
    assert all(n.endswith("Pred") and n[:2] == f"{v}_" for n, v in zip(out.features, "abc"))
    p = rows[list(out.features)].to_numpy()
    assert np.isfinite(p).all() and (p >= -1e-9).all() and np.allclose(p.sum(axis=1), 1)
    assert set(rows["prediction"]) <= set("abc")
    floor = 0.5 if name in NON_NEGATIVE | {"clf_bernoulli_nb"} else 0.8
    assert evaluate("accuracy", out) > floor


def test_discriminants_match_numpy(three):
    t, x, y = three
    out = collect(get_operator("clf_lda").fit_transform(t).df, "id")
    labels = sorted(set(y))
    means = np.array([x[y == v].mean(axis=0) for v in labels])
    pooled = sum((x[y == v] - m).T @ (x[y == v] - m) for v, m in zip(labels, means)) / len(x)
    logs = np.array(
        [np.log((y == v).mean()) - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(pooled), x - m) for v, m in zip(labels, means)]
    ).T
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    assert np.allclose(out[[f"{v}_LinearDiscriminantAnalysisPrimPred" for v in labels]], p / p.sum(axis=1, keepdims=True))


def test_wide_moments_through_arrow_equal_expressions(spark, monkeypatch):
    import tabloom.functions.stats as stats

    t, x, y = blobs(spark, p=5)
    narrow, per = stats.moments(t), stats.moments(t, by_class=True)
    monkeypatch.setattr(stats, "EXPRESSION_WIDTH", 2)
    wide, per_wide = stats.moments(t), stats.moments(t, by_class=True)
    assert np.allclose(narrow.scatter, wide.scatter) and np.allclose(narrow.covariance, np.cov(x.T, bias=True))
    assert all(np.allclose(per[v].scatter, per_wide[v].scatter) for v in per)


@pytest.mark.parametrize("settings", [{}, {"block_rows": 17, "rows_per_pivot": 20}, {"block_rows": 500, "rows_per_pivot": 9}])
def test_neighbours_are_exact_with_a_crowded_point(spark, settings):
    """A third of the training rows are copies of one point."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 3, (300, 2)).round(2)
    x[:100] = x[0]
    q = rng.normal(0, 3, (60, 2)).round(2)
    q[:10] = x[0]
    names = ["a", "b"]
    train = table(spark, [(i, "uv"[i % 2], *map(float, r)) for i, r in enumerate(x)], "id int, y string, a double, b double", label="y", features=names)
    test = table(spark, [(i, *map(float, r)) for i, r in enumerate(q)], "id int, a double, b double", features=names)
    got = nearest(train, test, 4, **settings).select("qkey.id", "rank", "d2", "y").toPandas().sort_values(["id", "rank"])
    d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    want = [sorted((d[i, j], j) for j in range(300))[:4] for i in range(60)]
    assert np.allclose(got["d2"].to_numpy().reshape(60, 4), [[v for v, _ in w] for w in want])
    assert (got["y"].to_numpy().reshape(60, 4) == np.array([["uv"[j % 2] for _, j in w] for w in want])).all()


def test_majority_vote_matches_whole_labels(spark):
    rows = [(1, "1", 0.2, 0.9), (2, "10", 0.8, 0.3)]
    df = spark.createDataFrame(rows, ["id", "y", "1_aPred", "10_aPred"])
    t = Table.of(df, "id", "y", task="classification")
    out = collect(MajorityVote().fit_transform(t).df, "id")
    assert out["prediction"].tolist() == ["10", "1"]
    tie = table(spark, [(1, "a", 0.5, 0.5), (2, "b", 0.5, 0.5)], "id int, y string, a_xPred double, b_xPred double", label="y")
    assert set(MajorityVote().fit_transform(tie).df.toPandas()["prediction"]) == {"a"}


def test_balanced_accuracy_special_cases(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "c"), ("b", "b"), ("a", "b")], "y string, p string")
    a = (1 / 2 + 2 / 2) / 2
    b = (1 / 2 + 1 / 2) / 2
    assert np.isclose(balanced_accuracy(df, "y", "p").first()[0], (a + b + 0) / 3)
    one = spark.createDataFrame([("a", "a"), ("a", "b")], "y string, p string")
    assert balanced_accuracy(one, "y", "p").first()[0] is None


def test_missing_values_reach_only_the_tolerant_learner(spark):
    rows = [(i, "ab"[i % 2], None if i % 3 == 0 else float(i % 2) + 0.01 * i) for i in range(90)]
    t = table(spark, rows, "id int, y string, x double", label="y")
    out = get_operator("clf_xgb", rounds=3).fit_transform(t)
    assert evaluate("accuracy", out) > 0.6


@pytest.mark.parametrize("name", ["reg_ard", "reg_bagging", "reg_adaboost", "ens_random_forest_regressor"])
def test_regressors(spark, name):
    t, x, _ = blobs(spark, p=3, gap=0.0, seed=8)
    y = 3 * x[:, 0] - x[:, 1] + 10
    rows = [(i, float(y[i]), *map(float, x[i])) for i in range(len(x))]
    r = table(spark, rows, "id int, y double, f0 double, f1 double, f2 double", label="y", task=REGRESSION)
    out = get_operator(name, **({"rounds": 6} if name == "reg_adaboost" else {"depth": 6})).fit_transform(r)
    assert evaluate("mse", out) < (1e-3 if name == "reg_ard" else y.var() * 0.4)


def test_ridge_cv_scores_leave_one_out(three):
    t, x, y = three
    state = get_operator("clf_ridge_cv").fit(t).state
    z = x - x.mean(axis=0)
    best = {}
    for a in (0.1, 1.0, 10.0):
        total = 0.0
        for v in sorted(set(y)):
            target = np.where(y == v, 1.0, -1.0)
            inner = np.linalg.inv(z.T @ z + a * np.eye(3))
            fit = z @ inner @ (z.T @ (target - target.mean())) + target.mean()
            leverage = 1 / len(x) + np.einsum("ij,jk,ik->i", z, inner, z)
            total += (((target - fit) / (1 - leverage)) ** 2).sum()
        best[a] = total
    assert state["alpha"] == min(best, key=best.get)


def test_grid_of_logistic_fits_agrees_with_single_fit(spark):
    t, x, y = blobs(spark, n=200, classes=2, gap=0.7, seed=11)
    import tabloom.operators.linear as linear

    fixed = type("Fixed", (linear.LogisticRegressionCV,), {"grid": (1.0,)})()
    w = np.append(np.array(fixed.learn(t)["weights"][0]), fixed.learn(t)["bias"][0])
    z = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-z @ w))
    gradient = z.T @ ((y == "b") - p) - np.append(w[:-1], 0)
    assert np.abs(gradient).max() < 1e-3


def test_neighbours_visit_units_once_and_in_bounded_batches(spark, monkeypatch):
    """With no cell out of reach, a query row goes once to a unit, not once to each cell, in short Arrow batches."""
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(600, 16)), rng.normal(size=(70, 16))
    monkeypatch.setattr(neighbors, "HELD", 20_000)
    pivots = neighbors._Pivots(neighbors._side_by_side(x[:40]))
    cell, d = pivots.cells(x)
    sizes = dict(zip(*np.unique(cell, return_counts=True), strict=True))
    radius = np.full(40, -np.inf)
    near = np.full((40, 3), np.inf)
    for j in sizes:
        radius[j], near[j, : sizes[j]] = d[cell == j].max(), np.sort(d[cell == j])[:3]
    first, pieces = neighbors._units(sizes, 100)
    units = int((first + pieces).max())
    right = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(q)], "qkey int, h int, x array<double>").coalesce(1)
    visits = neighbors._visitors(right, pivots, radius, near, first, pieces, units, 3).select("qkey", "unit").collect()
    assert len(visits) == len(set(visits)) <= 70 * units < 70 * len(sizes) / 3
    rows, places, dist = neighbors._nearest_in(x, cell, q, np.full(70, np.inf), pivots, radius, 3, 7)
    exact = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(rows, kind="stable")
    assert (places[order].reshape(70, 3) == np.argsort(exact, axis=1, kind="stable")[:, :3]).all()


def test_a_missing_value_is_no_neighbour(spark):
    rows = [(i, "u", float(i), None if i == 3 else 0.0) for i in range(6)]
    t = table(spark, rows, "id int, y string, a double, b double", label="y", features=["a", "b"])
    got = nearest(t, t.where(F.col("id") == 2), 3).orderBy("rank").toPandas()
    assert got["d2"].tolist() == [0.0, 1.0, 4.0]
    with pytest.raises(Exception, match="missing value"):
        nearest(t, t, 3).collect()
