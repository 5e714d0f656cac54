import warnings

import numpy as np
import pytest

from tabloom import get_operator
from tests.helpers import blobs, table


def gradient(x, y, w, b, C, kind):
    """Gradient of C * sum loss + |w|^2 / 2 (and b^2 / 2 for the hinge), by plain numpy."""
    m = y * (x @ w + b)
    slope = -2 * np.maximum(0, 1 - m) if kind == "hinge" else -1 / (1 + np.exp(m))
    return np.append(C * x.T @ (slope * y) + w, C * (slope * y).sum() + (b if kind == "hinge" else 0))


@pytest.mark.parametrize("name,kind", [("clf_linear_svc", "hinge"), ("clf_logistic_regression_cv", "logistic")])
@pytest.mark.parametrize("shift,spread", [(0.0, 1.0), (50.0, 0.01)])
def test_gradients_vanish(spark, name, kind, shift, spread):
    t, x, y = blobs(spark, gap=1.0, n=400)
    moved = t.derive({"f0": t.number("f0"), "f1": t.number("f1") * spread + shift, "f2": t.number("f2") * 7})
    x = np.column_stack([x[:, 0], x[:, 1] * spread + shift, x[:, 2] * 7])
    state = get_operator(name).fit(moved).state
    assert state["converged"] and state["gradient"] <= 1e-6
    C = state.get("C", 1.0)
    for k, label in enumerate(state["labels"]):
        sign = np.where(y == label, 1.0, -1.0)
        at = gradient(x, sign, np.array(state["weights"][k]), state["bias"][k], C, kind)
        zero = gradient(x, sign, np.zeros(3), 0.0, C, kind)
        assert np.linalg.norm(at) <= 1e-3 * max(1.0, np.linalg.norm(zero))


def test_partitions_do_not_matter(spark):
    one, _, _ = blobs(spark, gap=1.0, partitions=1)
    many, _, _ = blobs(spark, gap=1.0, partitions=13)
    a, b = (get_operator("clf_linear_svc").fit(t).state for t in (one, many))
    assert np.allclose(a["weights"], b["weights"], rtol=1e-5) and np.allclose(a["bias"], b["bias"], rtol=1e-5)


def test_an_unfinished_fit_says_so(spark):
    t, _, _ = blobs(spark, gap=1.0)
    with pytest.warns(UserWarning, match="stopped after"):
        assert not get_operator("clf_linear_svc", max_steps=1).fit(t).state["converged"]


def test_separable_and_constant_columns(spark):
    rows = [(i, "ab"[i % 2], float(i % 2), 3.0) for i in range(60)]
    t = table(spark, rows, "id int, y string, f double, same double", label="y", features=["f", "same"])
    for name in ("clf_linear_svc", "clf_logistic_regression_cv"):
        with warnings.catch_warnings():
            warnings.filterwarnings("error", message="trust-region")
            out = get_operator(name).fit_transform(t)
        assert out.df.where("prediction <> y").count() == 0


def test_many_classes_and_features_make_no_square_matrix(spark):
    """20 classes of 60 features: a pass returns 20 * 61 numbers, in chunks."""
    t, _, y = blobs(spark, n=600, p=60, classes=20, gap=1.0)
    fitted = get_operator("clf_linear_svc", C=0.01, tolerance=1e-3).fit(t)
    assert np.array(fitted.state["weights"]).shape == (20, 60) and fitted.state["converged"]
    assert fitted.transform(t).df.where("prediction = y").count() >= 0.95 * len(y)
