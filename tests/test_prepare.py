import pytest

from tabloom import Fitted, Table, get_operator
from tabloom.frame import c
from tabloom.operators.base import SchemaDrift
from tabloom.operators.prepare import feature_union, one_hot_vector, sanitize_name
from tests.helpers import collect, table

ROWS = [(1, 1.0, None, "b", None), (2, None, None, None, None), (3, 5.0, None, "a", None), (4, float("nan"), None, "b", None)]
SCHEMA = "id int, x double, empty double, s string, t string"


def gaps(spark):
    return table(spark, ROWS, SCHEMA)


def test_mean_treats_nan_as_missing_and_drops_empty_columns(spark):
    out = get_operator("impute_mean").fit_transform(gaps(spark))
    assert out.features == ("x_imp_mean",)
    assert collect(out.df, "id")["x_imp_mean"].tolist() == [1.0, 3.0, 5.0, 3.0]


def test_suffix_follows_the_fit_table(spark):
    whole = table(spark, [(1, 1.0), (2, 3.0)], "id int, x double")
    holes = table(spark, [(1, None), (2, 3.0)], "id int, x double")
    out = get_operator("impute_median").fit(whole).transform(holes)
    assert out.features == ("x",)
    assert collect(out.df, "id")["x"].tolist() == [2.0, 3.0]


def test_indicator(spark):
    out = get_operator("impute_indicator").fit_transform(gaps(spark))
    assert out.features == ("x", "x_miss_indicator")
    assert collect(out.df, "id")["x_miss_indicator"].tolist() == [0.0, 1.0, 0.0, 1.0]


def test_one_hot_missing_level_and_unseen(spark):
    f = get_operator("one_hot").fit(gaps(spark))
    assert f.state["levels"] == {"s": ["NaN", "a", "b"], "t": ["NaN"]}
    new = table(spark, [(9, 0.0, None, "zzz", None)], SCHEMA)
    row = f.transform(new).df.first()
    assert [row[f"one_hot__x0_{v}"] for v in ("NaN", "a", "b")] == [0.0, 0.0, 0.0]
    old = collect(f.transform(gaps(spark)).df, "id")
    assert (old[[n for n in old if n.startswith("one_hot__x0")]].sum(axis=1) == 1).all()


def test_one_hot_refuses_unbounded_levels(spark):
    t = table(spark, [(i, f"v{i}") for i in range(50)], "id int, s string")
    with pytest.raises(ValueError, match="levels"):
        get_operator("one_hot", max_levels=20).fit(t)
    model = one_hot_vector(t, "s", "v")
    assert model.transform(t.df).count() == 50


@pytest.mark.parametrize("limit", [200, 3])
def test_label_codes_are_sorted_positions(spark, limit):
    t = table(spark, [(i, f"v{i % 7}") for i in range(30)], "id int, s string")
    out = get_operator("label_encode", literal_levels=limit).fit_transform(t)
    assert collect(out.df, "id")["s_lbl_enc"].tolist() == [i % 7 for i in range(30)]


def test_label_encode_unseen_raises(spark):
    f = get_operator("label_encode").fit(table(spark, [(1, "a")], "id int, s string"))
    with pytest.raises(Exception, match="not seen"):
        f.transform(table(spark, [(1, "q")], "id int, s string")).df.collect()


def test_min_fraction_collapses_rare(spark):
    t = table(spark, [(i, "a" if i < 95 else f"r{i}") for i in range(100)], "id int, s string")
    out = get_operator("one_hot_min_fraction", minimum_fraction=0.05).fit_transform(t)
    assert out.features == ("s_a", "s_other")
    assert out.df.selectExpr("sum(s_a)", "sum(s_other)").first() == (95.0, 5.0)


def test_union_drops_repeats_and_sorts_later_columns(spark):
    t = table(spark, [(1, 1.0, 2.0, 3.0)], "id int, b double, a double, z double")
    u = feature_union(t.pick(["b"]), t.pick(["z", "a", "b"]))
    assert u.features == ("b", "a", "z")
    assert u.df.select("a", "b", "z").first() == (2.0, 1.0, 3.0)
    assert sanitize_name("a[1]<b>") == "aabaqa1bebabcfckcbdmdad"


def test_dotted_names_and_schema_drift(spark):
    t = Table.of(spark.createDataFrame([(1, 2.0, 4.0)], "id int, `a.b` double, `c d` double"), "id")
    f = get_operator("minmax_scale").fit(t)
    assert f.transform(t).features == ("a.b_mnmxscale", "c d_mnmxscale")
    with pytest.raises(SchemaDrift):
        f.transform(t.derive({"a.b": c("a.b")}))


def test_state_round_trips_as_json(spark):
    t = gaps(spark)
    for name in ("impute_mean", "one_hot", "impute_one_hot", "label_encode"):
        f = get_operator(name).fit(t)
        again = Fitted.from_json(f.to_json())
        assert collect(again.transform(t).df, "id").equals(collect(f.transform(t).df, "id"))


def test_timestamps_are_refused(spark):
    df = spark.sql("select 1 id, current_timestamp() ts")
    with pytest.raises(TypeError, match="cast first"):
        Table.of(df, "id")
