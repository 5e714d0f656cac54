import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tabloom.llm.quality_classifier import (
    FEATURES, RUNS_AT, dual_coordinate_descent, feature_sets, fit, fit_rows, op6_nb_svm_quality, score,
)

CLEAN = "the river runs past the old mill and turns towards the sea number {}"
JUNK = "buy*** now$$$ {} click### here&&& free%%% win***"


def test_features_are_distinct_ngrams_of_each_text():
    texts = ["abcabc", "", None, "x", "go go go stop stop", "é\nb"]
    sets = [set(s.tolist()) for s in feature_sets(pa.array(texts))]
    for text, found in zip(texts, sets):
        raw = (text or "").encode()
        want = set(raw) | {(a << 8 | b) + 256 for a, b in zip(raw, raw[1:])}
        assert {f for f in found if f < 256 + 65536} == want
    assert {f for f in sets[4] if f >= RUNS_AT} == {RUNS_AT, RUNS_AT + 1} and len(sets[0]) == 3 + 3 + 3
    assert list(feature_sets(pa.array([], pa.string()))) == []


def test_descent_finds_the_hinge_optimum():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    good = np.array([(s < 12).mean() + rng.normal(0, 0.2) > 0.4 for s in sets])
    ratios = np.zeros(FEATURES)
    ratios[:30] = rng.normal(size=30)
    w, b = dual_coordinate_descent(sets, ratios, good, tolerance=1e-6, passes=5000)
    sign = np.where(good, 1, -1)
    x = np.zeros((60, 31))
    for i, s in enumerate(sets):
        x[i, s] = ratios[s] / np.linalg.norm(ratios[s])
    x[:, 30] = 1

    def loss(v):
        return 0.5 * v @ v + np.maximum(0, 1 - sign * (x @ v)).sum()

    found = np.append(w[:30], b)
    assert all(loss(found) <= loss(found + rng.normal(size=31) * s) + 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_held_out_accuracy(spark):
    out = op6_nb_svm_quality(spark, "/root/testdata/sf0.01")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.97 and sum(r.predicted == r.quality for r in rows) > 0.93 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def frame(spark):
    rows = [(i, (CLEAN if i % 2 else JUNK).format(i), "en", i % 2) for i in range(200)]
    rows += [(1000, None, None, 1), (1001, "", "en", 0), (1002, "word " * 30_000, "en", None), (None, "no id", "en", 1), (3, CLEAN, "en", 1), (4, JUNK, "en", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, label int").withColumns({c: F.lit("x") for c in ("score", "features", "known_id", "bias")})


def test_hard_rows(spark):
    docs = frame(spark)
    model = fit(docs.drop("label"), docs.select("doc_id", "label"))
    out = score(docs, model).collect()
    assert len(out) == docs.count() and set(out[0].asDict()) == set(docs.columns) | {"predicted"}
    assert all(r.predicted == r.label for r in out if r.doc_id is not None and r.doc_id < 200 and r.label != 7)
    assert len({r.score for r in out if r.doc_id in (1000, 1001)}) == 1


def test_label_rows_decide_nothing_at_scoring(spark):
    docs = frame(spark)
    model = fit(docs.drop("label"), docs.select("doc_id", "label"))
    one = {r.text: r.score for r in score(docs, model).collect()}
    other = {r.text: r.score for r in score(docs.select("text", F.lit(0).alias("doc_id"), F.lit("zz").alias("lang")), model).collect()}
    assert one == other


def test_one_class_and_no_rows(spark):
    docs = frame(spark)
    none = fit(docs, docs.select("doc_id", "label").limit(0))
    assert {round(r.score, 6) for r in score(docs, none).collect()} == {0.5}
    assert score(docs.limit(0), none).count() == 0
    ones = fit_rows([np.array([1, 2])] * 20, np.ones(20, dtype=bool))
    assert ones.scores(iter([np.array([1])]))[0] > 0.9


def test_a_repeated_id_counts_once_and_one_task_reads_features_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, (CLEAN if i % 2 else JUNK).format(i)) for i in range(200)], "doc_id long, text string").repartition(4)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    plain = fit(docs, labels)
    hot = docs.unionByName(docs.filter("doc_id = 7").crossJoin(spark.range(300)).select("doc_id", "text"))
    seen = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: seen.append(df) or collect(df))
    again = fit(hot, labels)
    assert (again.weights == plain.weights).all() and (again.ratios == plain.ratios).all() and again.bias == plain.bias
    plan = seen[-1]._jdf.queryExecution().sparkPlan().toString()
    train = plan.index("MapInArrow")
    assert "Coalesce" not in plan and train < plan.index("Exchange", train) < plan.index("MapInArrow", train + 1)
