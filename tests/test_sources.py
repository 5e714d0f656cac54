import numpy as np
from pyspark.sql import functions as F

from tabloom import Table, get_operator
from tabloom.sources.readers import dataset_name, read_dataset_dir, read_dataset_paths, read_table
from tabloom.sources.sinks import append_new, write_baseline_scores, write_metafeatures, write_run_log
from tabloom.streaming.apply import stream_table, transform_stream, write_stream
from tabloom.streaming.pca import IncrementalPca


def test_csv_with_awkward_header(spark, tmp_path):
    path = tmp_path / "wine.small.csv"
    path.write_text('id,"a b",c/d,"two\nlines",class\n1,1.5,x,7,FALSE\n2,,y,8,TRUE\n')
    t = read_table(spark, str(path), "id", multiline=True)
    assert t.label == "class" and t.features == ("a b", "c/d", "two\nlines")
    assert t.numeric == ["a b", "two\nlines"] and t.df.count() == 2
    assert dataset_name(str(path)) == "wine"
    assert get_operator("impute_mean").fit_transform(t).features == ("a b_imp_mean", "two\nlines")


def test_folder_of_files(spark, tmp_path):
    for name, n in (("one", 2), ("two", 3)):
        (tmp_path / f"{name}.csv").write_text("id,v\n" + "".join(f"{i},{i}\n" for i in range(n)))
    both = read_dataset_paths(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], key="id")
    assert {k: t.df.count() for k, t in both.items()} == {"one": 2, "two": 3}
    spark.range(4).write.parquet(str(tmp_path / "p" / "a.parquet"))
    frame = read_dataset_dir(spark, str(tmp_path / "*.csv").replace("*.csv", "one.csv"))
    assert {r["dataset"] for r in frame.collect()} == {"one"}


def test_known_rows_are_not_written_twice(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = spark.createDataFrame([("d", "s", "l1", 0.5), ("d", "s", "l2", 0.6)], "dataset string, setting string, learner string, score double")
    assert write_baseline_scores(rows, path).count() >= 0
    again = rows.unionByName(spark.createDataFrame([("d", "s", "l3", 0.7)], rows.schema))
    write_baseline_scores(again, path)
    assert spark.read.parquet(path).count() == 3


def test_run_log_and_metafeature_sink(spark, tmp_path):
    pipes = spark.createDataFrame([("p1", "{}")], "id string, steps string")
    runs = spark.createDataFrame([("j", "classification", "accuracy", "d", "p1", 0.5)], "job string, task string, metric string, dataset string, pipeline_id string, score double")
    for _ in range(2):
        write_run_log(pipes, runs, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log" / "runs")).count() == 1
    append_new(runs.withColumn("score", F.lit(0.9)), str(tmp_path / "log" / "runs"), ["pipeline_id", "score"])
    assert spark.read.parquet(str(tmp_path / "log" / "runs")).count() == 2
    write_metafeatures(spark.createDataFrame([("B", 1.0), ("A", 2.0)], "name string, value double"), str(tmp_path / "mf"), "d")
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "mf")).collect()] == ["A", "B"]


def events(spark, sf) -> Table:
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value", "user_id")
    return Table.of(df, "event_id", "event_type", ["value", "user_id"], "classification")


def as_files(t: Table, folder: str) -> None:
    t.df.repartitionByRange(3, "event_id").write.parquet(folder)


def test_fitted_operators_apply_to_a_stream(spark, sf, tmp_path):
    t = events(spark, sf)
    fitted, step = [], t
    for name in ("standard_scale", "clf_gaussian_nb"):
        fitted.append(get_operator(name).fit(step))
        step = fitted[-1].transform(step)
    as_files(t, str(tmp_path / "in"))
    stream = stream_table(spark, str(tmp_path / "in"), t.df.schema, t)
    out = transform_stream(stream, fitted)
    assert out.df.isStreaming
    write_stream(out.df, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == t.df.count() and got.exceptAll(step.df.select(*got.columns)).count() == 0


def test_incremental_components_equal_batch_ones(spark, sf, tmp_path):
    t = events(spark, sf)
    as_files(t, str(tmp_path / "in"))
    sink = IncrementalPca(t, str(tmp_path / "stats"), np.array([200.0, 70.0]))
    stream = stream_table(spark, str(tmp_path / "in"), t.df.schema, t)
    run = stream.df.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stats")).count() == 3
    m, variance, axes = sink.axes(spark)
    state = get_operator("pca_full").fit(t).state
    assert m.n == t.df.count() and np.allclose(axes, state["axes"]) and np.allclose(variance, state["variance"])


def test_large_csv_is_split(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("id,v\n" + "".join(f"{i},{i}\n" for i in range(200_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        assert read_table(spark, str(path), "id").df.rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_workers_get_the_package_from_any_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as e\n"
        "from tabloom.session import local_session\n"
        "spark = local_session('2', memory='1g')\n"
        "print('ROWS', e.queries()['score_f_classif'](spark, '/root/testdata/sf0.001').count())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "ROWS 64" in done.stdout, done.stderr[-2000:]
