import math

import numpy as np

from tabloom.plans.columnstats import column_statistics, first_appearance_codes, summarise
from tabloom.plans.profile import ALL, SUBSETS, metafeature_profile, metafeature_values
from tests.helpers import blobs, table


def test_values_on_a_small_table(spark):
    rows = [(1, "a", 1.0, "x"), (2, "a", None, None), (3, "b", float("inf"), "y"), (4, "b", 4.0, "x")]
    t = table(spark, rows, "id int, y string, v double, s string", label="y")
    names = [n for n in ALL if not n.startswith(("Landmark", "PCA", "Kurt", "Skew", "Corr"))]
    v = metafeature_values(t, names)
    assert v["NumberOfInstances"] == 4 and v["NumberOfMissingValues"] == 2 and v["PercentageOfMissingValues"] == 0.25
    assert v["NumberOfInstancesWithMissingValues"] == 2 and v["NumberOfFeaturesWithMissingValues"] == 1
    assert v["SymbolsSum"] == 3 and v["ClassEntropy"] == 1.0 and v["RatioNominalToNumerical"] == 1.0
    assert math.isclose(v["LogDatasetRatio"], math.log(0.5))


def test_empty_table_gives_the_marker(spark):
    t = table(spark, [], "id int, y string, v double", label="y")
    assert set(r["value"] for r in metafeature_profile(t).collect()) == {-99.0}


def test_landmarks_and_components(spark):
    t, x, _ = blobs(spark, n=200)
    v = metafeature_values(t, SUBSETS["pfahringer_2000"])
    assert v["LandmarkLDA"] > 0.9 and v["LandmarkNaiveBayes"] > 0.9 and v["LandmarkDecisionTree"] > 0.8
    w = metafeature_values(t, ["PCAFractionOfComponentsFor95PercentVariance", "Landmark1NN", "KurtosisMax"])
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert w["PCAFractionOfComponentsFor95PercentVariance"] == (np.searchsorted(values.cumsum() / 3, 0.95) + 1) / 3
    assert w["Landmark1NN"] > 0.9
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.isclose(w["KurtosisMax"], ((z**4).mean(axis=0) - 3).max())


def test_statistics_by_group(spark):
    rows = [(i, "ab"[i % 2], float(i), float(i * i), "uv"[i % 2]) for i in range(20)]
    t = table(spark, rows, "id int, y string, p double, q double, s string", label="y")
    got = {(r["grp"], r["mf"], r["a"], r["b"]): r["value"] for r in column_statistics(t).collect()}
    assert math.isclose(got["Features", "spearman", "p", "q"], 1.0)
    assert math.isclose(got["FeaturesLabels", "mutual_information", "s", "y"], 1.0)
    assert got["Labels", "entropy", "y", None] == 1.0 and got["Features", "mean", "p", None] == 9.5
    names = {r["name"]: r["value"] for r in summarise(column_statistics(t)).collect()}
    assert math.isclose(names["Features.pearson.non_aggregated"], got["Features", "pearson", "p", "q"])
    assert math.isclose(names["Features.mean.mean"], (9.5 + sum(i * i for i in range(20)) / 20) / 2)


def test_codes_in_order_of_first_appearance(spark):
    t = table(spark, [(3, "z"), (1, "m"), (2, "z"), (4, "a")], "id int, s string")
    for size in (10**6, 1):
        codes = {r["level"]: r["code"] for r in first_appearance_codes(t, "s", "id", rows_per_range=size).collect()}
        assert codes == {"m": 0, "z": 1, "a": 2}
