import numpy as np
import pytest

from tabloom import get_operator
from tabloom.plans.contracts import accepts, needed, profile_table
from tests.helpers import blobs, collect, table


def frame(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(v), 5.0, float(i % 4)) for i, v in enumerate(rng.lognormal(0, 1, 200))]
    return table(spark, rows, "id int, x double, flat double, few double")


@pytest.mark.parametrize("name", ["minmax_scale", "maxabs_scale", "robust_scale", "standard_scale", "quantile_transform"])
def test_constant_column_stays_finite(spark, name):
    out = get_operator(name).fit_transform(frame(spark))
    values = collect(out.df, "id")[list(out.features)].to_numpy()
    assert np.isfinite(values).all()
    if name in ("minmax_scale", "quantile_transform"):
        assert values.min() >= 0 and values.max() <= 1
        assert (values[:, 1] == 0).all()


def test_standard_scale_is_population(spark):
    t, x, _ = blobs(spark)
    out = collect(get_operator("standard_scale").fit_transform(t).df, "id")
    want = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose(out[[f"f{i}_stndrdscale" for i in range(3)]].to_numpy(), want)


def test_one_hot_columns_keep_their_name(spark):
    t = table(spark, [(1, 0.0, 1.0), (2, 1.0, 3.0)], "id int, one_hot__x0_a double, v double")
    assert get_operator("minmax_scale").fit_transform(t).features == ("one_hot__x0_a", "v_mnmxscale")


def test_quantile_landmarks_both_ways_agree(spark, monkeypatch):
    import tabloom.operators.scale as scale

    t = frame(spark).pick(["x", "few"])
    batch = collect(get_operator("quantile_transform", landmarks=50).fit_transform(t).df, "id")
    monkeypatch.setattr(scale, "EXPRESSION_MARKS", 10**6)
    plain = collect(get_operator("quantile_transform", landmarks=50).fit_transform(t).df, "id")
    assert np.allclose(batch, plain)
    marks = np.quantile(t.df.toPandas()["x"], np.linspace(0, 1, 50))
    want = np.interp(t.df.toPandas().sort_values("id")["x"], marks, np.linspace(0, 1, 50))
    assert np.allclose(plain["x_qntl"], want)


def test_power_transform_finds_the_likeliest_exponent(spark):
    t = frame(spark).pick(["x"])
    found = get_operator("power_transform").fit(t).state["power"]["x"][0]
    x = np.array([r[0] for r in t.df.select("x").collect()])

    def likelihood(lam):
        y = ((x + 1) ** lam - 1) / lam
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * np.log1p(x).sum()

    grid = np.linspace(-3, 2, 5001)
    assert abs(found - grid[np.argmax([likelihood(v) if abs(v) > 1e-9 else -np.inf for v in grid])]) < 0.005


def test_bins_are_right_open_and_last_closed(spark):
    t = table(spark, [(i, float(i)) for i in range(11)], "id int, x double")
    out = collect(get_operator("kbins_ordinal").fit_transform(t).df, "id")["x_ordnldscrtzr"]
    assert out.tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4]
    hot = get_operator("kbins_one_hot").fit_transform(t)
    assert hot.features == tuple(f"x_onhtbnrzr{j}" for j in range(5))
    assert (collect(hot.df, "id")[list(hot.features)].sum(axis=1) == 1).all()


def test_transform_uses_only_train_state(spark):
    train = table(spark, [(1, 0.0), (2, 10.0)], "id int, x double")
    test = table(spark, [(1, 20.0)], "id int, x double")
    assert get_operator("minmax_scale").fit(train).transform(test).df.first()["x_mnmxscale"] == 2.0


def test_contracts(spark):
    t = frame(spark)
    p = profile_table(t)
    assert p.distinct["few"] == 4 and p.distinct["flat"] == 1
    assert accepts("c_t", p) and not accepts("c_t_kbins", p) and accepts("c_t_kbins", profile_table(t.pick(["x"])))
    bad = table(spark, [(1, float("inf"), "a"), (2, 1.0, None)], "id int, x double, s string")
    q = profile_table(bad.pick(["x"]))
    assert not accepts("c", q) and accepts("a", q) and accepts("d", q)
    assert needed("has_categorical", profile_table(bad)) and needed("has_missing_and_categorical", profile_table(bad))
    empty = profile_table(t.where(t.df["x"] < -1))
    assert not any(accepts(k, empty) for k in ("a", "b", "c", "c_t", "d"))
