import math

import numpy as np
import pytest

from tabloom import get_operator
from tabloom.frame import REGRESSION, c
from tabloom.functions.pvalues import chi2_tail, f_tail
from tabloom.operators.scores import SCORES
from tests.helpers import blobs, table


@pytest.mark.parametrize("x", [0.1, 1.0, 3.0, 20.0, 80.0])
def test_tails_match_closed_forms(x):
    assert math.isclose(chi2_tail(x, 2), math.exp(-x / 2), rel_tol=1e-10)
    assert math.isclose(chi2_tail(x, 4), math.exp(-x / 2) * (1 + x / 2), rel_tol=1e-10)
    assert math.isclose(f_tail(x, 2, 30), (1 + 2 * x / 30) ** -15, rel_tol=1e-9)
    # F(1, 1) is the square of a Cauchy variable.
    assert math.isclose(f_tail(x, 1, 1), 1 - 2 / math.pi * math.atan(math.sqrt(x)), rel_tol=1e-9)


def test_anova_matches_definition(spark):
    t, x, y = blobs(spark, gap=0.5)
    got = {r["feature"]: r["score"] for r in SCORES["f_classif"](t).collect()}
    groups = [x[y == v] for v in sorted(set(y))]
    for i in range(3):
        between = sum(len(g) * (g[:, i].mean() - x[:, i].mean()) ** 2 for g in groups) / (len(groups) - 1)
        within = sum(((g[:, i] - g[:, i].mean()) ** 2).sum() for g in groups) / (len(x) - len(groups))
        assert np.isclose(got[f"f{i}"], between / within)


def noisy(spark):
    t, x, _ = blobs(spark, n=400, p=6, gap=0.0, seed=5)
    cols = {f"f{i}": c(f"f{i}") for i in range(6)}
    cols["signal"] = c("f0") * 0.1 + (c("y") == "a").cast("double") * 3
    return t.derive(cols)


def test_selection_rules_nest(spark):
    t = noisy(spark)
    kept = {r: set(get_operator(f"select_f_classif_{r}").fit(t).state["keep"]) for r in ("fpr", "fdr", "fwe")}
    assert "signal" in kept["fwe"] and kept["fwe"] <= kept["fdr"] <= kept["fpr"]
    best = get_operator("select_f_classif_kbest", k=1).fit(t).state["keep"]
    assert best == ["signal"]
    assert get_operator("select_mi_classif_kbest", k=1).fit(t).state["keep"] == ["signal"]
    assert len(get_operator("select_f_classif_kbest").fit(t).state["keep"]) == 7


def test_empty_selection_passes_through_and_is_flagged(spark):
    rows = [(i, "ab"[i % 2], 1.0 + (i // 2) % 3) for i in range(60)]
    t = table(spark, rows, "id int, y string, x double", label="y")
    f = get_operator("select_chi2_fwe").fit(t)
    assert f.state["empty"] and f.transform(t).features == ("x",)


def test_constant_columns_go(spark):
    t = table(spark, [(1, 2.0, 1.0), (2, 2.0, 3.0)], "id int, flat double, x double")
    assert get_operator("variance_threshold").fit_transform(t).features == ("x",)


def test_regression_scores(spark):
    t, x, _ = blobs(spark, p=3, gap=0.0)
    y = 2 * x[:, 0] + 0.3 * x[:, 2]
    rows = [(i, float(y[i]), *map(float, x[i])) for i in range(len(x))]
    r = table(spark, rows, "id int, y double, f0 double, f1 double, f2 double", label="y", task=REGRESSION)
    got = {s["feature"]: s for s in SCORES["f_regression"](r).collect()}
    assert got["f0"]["p_value"] < 1e-10 < got["f1"]["p_value"]
    mi = {s["feature"]: s["score"] for s in SCORES["mi_regression"](r).collect()}
    assert mi["f0"] == max(mi.values())
    assert get_operator("rfe_linear_svr").fit(r).state["keep"] == ["f0"]
    assert get_operator("rfe_random_forest_regressor").fit(r).state["keep"] == ["f0"]
