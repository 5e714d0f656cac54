import numpy as np
import pandas as pd
import pytest

from tabloom import Table, get_operator
from tabloom.frame import CLASSIFICATION
from tabloom.operators import gradient
from tabloom.operators.base import Fitted
from tabloom.operators.gradient import Boosting, Plan, binned, histograms, route, slopes


def table(spark, x, y, partitions=3):
    rows = [tuple([i, y[i].item()] + [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    names = [f"f{j}" for j in range(x.shape[1])]
    kind = "string" if isinstance(rows[0][1], str) else "int"
    df = spark.createDataFrame(rows, f"id long, y {kind}, " + ", ".join(f"{n} double" for n in names)).repartition(partitions)
    return Table.of(df, "id", "y", names, CLASSIFICATION)


def scores(t, name, **params):
    fitted = get_operator(name, **params).fit(t)
    out = fitted.transform(t)
    return fitted, out.df.orderBy("id").toPandas()[["prediction", *out.features]]


def stump_by_hand(x, y, k, rate=0.1, penalty=0.0):
    """Probabilities after one round of depth 1, by trying every cut of every column."""
    share = np.bincount(y, minlength=k) / len(y)
    margins = np.tile(np.log(share), (len(y), 1))
    for c in range(k):
        g, h = share[c] - (y == c), np.full(len(y), share[c] * (1 - share[c]) * k / (k - 1))
        best = (0, None)
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            for cut in (v[1:] + v[:-1]) / 2:
                m = x[:, f] <= cut
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (m, ~m)) - g.sum() ** 2 / (h.sum() + penalty)
                if gain > best[0] + 1e-12:
                    best = (gain, m)
        for s in (best[1], ~best[1]):
            margins[s, c] -= rate * g[s].sum() / (h[s].sum() + penalty)
    e = np.exp(margins)
    return e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("one_task", [100_000, 0])
def test_a_round_is_the_best_cut_of_each_class(spark, one_task):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 30, (250, 3)).astype(float)
    y = (x[:, 1] > 10).astype(int) + (x[:, 2] + rng.normal(size=250) > 20)
    _, got = scores(table(spark, x, np.array(["a", "b", "c"])[y]), "clf_gradient_boosting", rounds=1, depth=1, one_task=one_task)
    np.testing.assert_allclose(got.iloc[:, 1:].to_numpy(float), stump_by_hand(x, y, 3), rtol=1e-9)


@pytest.mark.parametrize("name", ["clf_gradient_boosting", "clf_xgb", "clf_lightgbm"])
def test_one_task_and_many_jobs_agree(spark, monkeypatch, name):
    monkeypatch.setattr(gradient, "CUT_EVERY", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    if name == "clf_xgb":
        x[rng.random(x.shape) < 0.2] = np.nan
    t = table(spark, x, y)
    (one, a), (_, b) = scores(t, name, rounds=5), scores(t, name, rounds=5, one_task=0)
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9)
    assert len(one.state["rounds"]) == 5 and (a["prediction"].to_numpy() == y).mean() > 0.75
    _, again = scores_of(Fitted.from_json(one.to_json()), t)
    pd.testing.assert_frame_equal(a, again)


def scores_of(fitted, t):
    out = fitted.transform(t)
    return fitted, out.df.orderBy("id").toPandas()[["prediction", *out.features]]


def test_loss_falls_and_classes_are_found(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 600)
    x = rng.normal(size=(600, 5)) + np.eye(5)[y] * 3
    t = table(spark, x, y)
    losses = []
    for rounds in (1, 10, 60):
        _, got = scores(t, "clf_gradient_boosting", rounds=rounds)
        p = got.iloc[:, 1:].to_numpy(float)
        assert np.allclose(p.sum(axis=1), 1)
        losses.append(-np.log(p[np.arange(600), y]).mean())
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.2 and (got["prediction"].to_numpy() == y).mean() > 0.97


def test_missing_values_learn_their_side(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    x = np.where(y == 1, np.where(rng.random(400) < 0.5, np.nan, 5.0), 0.0)[:, None] + 0.01 * rng.normal(size=(400, 1))
    _, got = scores(table(spark, x, y), "clf_xgb", rounds=10)
    assert (got["prediction"].to_numpy() == y).all()


def test_leaves_grow_best_first():
    """With 31 leaves and no depth the splits used are those of the highest gains, each after its parent."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3))
    y = (np.sin(3 * x[:, 0]) + x[:, 1] * x[:, 2] > 0).astype(int)
    cuts = [np.quantile(x[:, f], np.arange(1, 64) / 64).tolist() for f in range(3)]
    bins = binned(x, cuts)
    made = Boosting(None, Plan(rounds=1, depth=None, leaves=8, least_rows=20), np.bincount(y), [63] * 3, 65)
    made.source = gradient.InTask(bins, y, 2, made.base, 65)
    tree = made.run()["rounds"][0][0]
    g, h = slopes(np.tile(made.base, (2000, 1)), y, 2)

    def gain(rows, f, b):
        m = bins[rows, f] <= b
        return sum(g[rows[s], 0].sum() ** 2 / h[rows[s], 0].sum() for s in (m, ~m)) - g[rows, 0].sum() ** 2 / h[rows, 0].sum() if min(m.sum(), (~m).sum()) >= 20 else 0

    leaves = [np.arange(2000)]
    while len(leaves) < 8:
        best = max((gain(r, f, b), i, f, b) for i, r in enumerate(leaves) for f in range(3) for b in range(63))
        rows = leaves.pop(best[1])
        m = bins[rows, best[2]] <= best[3]
        leaves += [rows[m], rows[~m]]
    end = route(tuple(np.array(tree[f]) for f in ("feature", "bin", "missing_left", "left", "right")), bins, 64)
    assert sorted(map(tuple, leaves)) == sorted(tuple(np.flatnonzero(end == e)) for e in np.unique(end))
    table_ = histograms([tuple(np.array(tree[f]) for f in ("feature", "bin", "missing_left", "left", "right"))], [(0, int(end[0]))], bins, g, h, 65)
    assert table_[0, 0, :, 2].sum() == (end == end[0]).sum()


def test_one_class_and_constant_columns(spark):
    x = np.ones((20, 2))
    x[:, 1] = np.nan
    _, got = scores(table(spark, x, np.zeros(20, int)), "clf_xgb", rounds=3)
    assert (got["prediction"] == 0).all()
    _, got = scores(table(spark, x, np.arange(20) % 2), "clf_xgb", rounds=3)
    assert np.allclose(got.iloc[:, 1:].to_numpy(float), 0.5)


@pytest.mark.parametrize("passed", [64_000_000, 0])
def test_passes_of_a_large_table_have_one_stage(spark, monkeypatch, passed):
    """Blocks stay with the executors; a written table is left for sums too large for the driver. Trees are the same."""
    monkeypatch.setattr(gradient, "PASSED", passed)
    monkeypatch.setattr(gradient, "CUT_EVERY", 2)
    monkeypatch.setattr(gradient, "RENEW_EVERY", 2)
    stages = []
    sums = gradient.OnBlocks.sums

    def counted(self, growing, wanted):
        group = f"pass {len(stages)}"
        spark.sparkContext.setJobGroup(group, "")
        out = sums(self, growing, wanted)
        tracker = spark.sparkContext.statusTracker()
        stages.append([len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group)])
        return out

    monkeypatch.setattr(gradient.OnBlocks, "sums", counted)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    t = table(spark, x, y, partitions=2)
    fitted, got = scores(t, "clf_lightgbm", rounds=5, one_task=0)
    assert bool(stages) == bool(passed) and all(len(s) == 1 for s in stages)
    one, want = scores(t, "clf_lightgbm", rounds=5)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9)
    assert [len(r[0]["feature"]) for r in fitted.state["rounds"]] == [len(r[0]["feature"]) for r in one.state["rounds"]]
