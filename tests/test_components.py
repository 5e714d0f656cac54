import numpy as np
import pytest

from tabloom import Table, get_operator
from tests.helpers import blobs, collect, table


def matrix(out):
    return collect(out.df, "id")[list(out.features)].to_numpy()


@pytest.mark.parametrize("name,k", [("pca_full", 6), ("pca_incremental", 6), ("pca_randomized", 6), ("pca_arpack", 5), ("kernel_pca", 3)])
def test_principal_components(spark, name, k):
    t, x, _ = blobs(spark, p=6)
    z = matrix(get_operator(name).fit_transform(t))
    assert z.shape == (300, k)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:k]
    assert np.allclose(z.var(axis=0, ddof=1), values)
    assert np.allclose(np.corrcoef(z.T), np.eye(k), atol=1e-8)


def test_components_rebuild_the_rows_and_fix_the_sign(spark):
    t, x, _ = blobs(spark, p=4)
    f = get_operator("pca_full").fit(t)
    axes, mean = np.array(f.state["axes"]), np.array(f.state["mean"])
    assert np.allclose(axes @ axes.T, np.eye(4))
    assert (axes[np.arange(4), np.abs(axes).argmax(axis=1)] > 0).all()
    assert np.allclose(matrix(f.transform(t)) @ axes + mean, x)


@pytest.mark.parametrize("p,solver", [(40, "qr"), (40, "gram"), (600, "qr")])
def test_leading_axes_at_any_width(spark, p, solver):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 3)) @ rng.standard_normal((3, p)) * [5] + 0.01 * rng.standard_normal((300, p)) + 7
    schema = "id int, x array<double>"
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], schema).repartition(3)
    names = [f"f{i}" for i in range(p)]
    t = Table.of(rows.selectExpr("id", *[f"x[{i}] AS {n}" for i, n in enumerate(names)]), "id", None, names)
    state = get_operator("pca_randomized", components=3, solver=solver).fit(t).state
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.svd(centred)[1:]
    assert state["converged"]
    assert np.allclose(np.abs((axes[:3] * np.array(state["axes"])).sum(axis=1)), 1, atol=1e-6)
    assert np.allclose(state["variance"], values[:3] ** 2 / 299, rtol=1e-6)
    assert np.allclose(state["ratio"], values[:3] ** 2 / (values**2).sum(), rtol=1e-6)


def test_triangle_keeps_small_variances_and_any_partitioning(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 2)) @ np.diag([1.0, 1e-9]) @ np.linalg.qr(rng.standard_normal((2, 2)))[0]
    found = []
    for parts in (1, 20):
        t = table(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
        state = get_operator("pca_randomized").fit(t.with_df(t.df.repartition(parts))).state
        found.append(state["variance"][1])
    exact = np.linalg.svd(x - x.mean(axis=0))[1][1] ** 2 / 199
    assert np.allclose(found, exact, rtol=1e-4, atol=0)


def test_moving_axes_are_reported(spark):
    t, _, _ = blobs(spark, p=20, gap=0.1)
    with pytest.warns(UserWarning, match="still moved"):
        state = get_operator("pca_randomized", components=2, passes=1).fit(t).state
    assert not state["converged"]
    with pytest.raises(ValueError):
        get_operator("pca_randomized", solver="none").fit(t)


def test_truncated_svd_is_not_centred(spark):
    t, x, _ = blobs(spark, p=4)
    z = matrix(get_operator("truncated_svd").fit_transform(t))
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(np.sqrt((z**2).sum(axis=0)), s[:2])


def test_ica_recovers_mixed_sources(spark):
    rng = np.random.default_rng(1)
    sources = np.stack([rng.uniform(-1, 1, 3000), np.sign(rng.standard_normal(3000)) * rng.exponential(1, 3000)])
    mixed = (np.array([[1.0, 0.6], [0.4, 1.0]]) @ sources).T
    t = table(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(mixed)], "id int, a double, b double")
    found = matrix(get_operator("fast_ica").fit_transform(t))
    fit = np.abs(np.corrcoef(found.T, sources)[:2, 2:])
    assert (fit.max(axis=1) > 0.98).all() and set(fit.argmax(axis=1)) == {0, 1}


def test_tree_embedding_has_one_leaf_per_tree(spark):
    t, _, _ = blobs(spark)
    out = get_operator("random_trees_embedding", trees=4, depth=3).fit_transform(t)
    z = matrix(out)
    assert (z.sum(axis=1) == 4).all() and (z.sum(axis=0) > 0).all() and z.shape[1] <= 4 * 8


def test_products(spark):
    t = table(spark, [(1, 2.0, 3.0)], "id int, a double, b double")
    poly = get_operator("polynomial_features").fit_transform(t)
    assert dict(zip(poly.features, poly.df.first()[1:])) == {"a": 2, "b": 3, "a^2": 4, "a b": 6, "b^2": 9}
    assert get_operator("interaction_features").fit_transform(t).features == ("a", "b", "a b")
