"""Append-only result tables: run logs, score caches, meta-feature values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.frame import c


def only_new(fresh: DataFrame, stored: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Rows of ``fresh`` whose id is not stored yet, one per id."""
    return fresh.dropDuplicates(list(id_columns)).join(
        stored.select(*[c(n) for n in id_columns]), list(id_columns), "left_anti"
    )


def pipeline_id(steps: Column) -> Column:
    """Step names followed by their '_'-joined inputs, concatenated in step order.

    ``steps`` is array<struct<index, name, inputs array<int>>>.
    """
    ordered = F.array_sort(steps)
    parts = F.transform(ordered, lambda s: F.concat(s["name"], F.array_join(s["inputs"].cast("array<string>"), "_")))
    return F.array_join(parts, "")


def append_new(fresh: DataFrame, path: str, id_columns: Sequence[str]) -> DataFrame:
    """Append the rows whose id the Parquet table at ``path`` lacks; returns them."""
    spark = fresh.sparkSession
    try:
        stored = spark.read.parquet(path)
        rows = only_new(fresh, stored, id_columns)
    except Exception as error:  # noqa: BLE001 - a missing table is the first append
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = fresh.dropDuplicates(list(id_columns))
    rows.write.mode("append").parquet(path)
    return rows


def write_run_log(pipelines: DataFrame, runs: DataFrame, folder: str) -> None:
    """Store pipelines by ``id`` and runs by (job, pipeline_id, score); known ids are skipped."""
    append_new(pipelines, f"{folder}/pipelines", ["id"])
    append_new(runs, f"{folder}/runs", ["job", "task", "metric", "dataset", "pipeline_id", "score"])


def write_baseline_scores(scores: DataFrame, path: str) -> DataFrame:
    """Cache of baseline scores, one set per dataset and evaluation setting."""
    return append_new(scores, path, ["dataset", "setting", "learner"])


def metafeature_rows(long: DataFrame, kind: str = "METAFEATURE") -> DataFrame:
    """Meta-feature values in storage form, sorted by name."""
    return long.select(
        "name",
        F.lit(kind).alias("type"),
        F.lit(0).alias("fold"),
        F.lit(0).alias("repeat"),
        F.col("value").cast("double").alias("value"),
        F.lit(None).cast("double").alias("time"),
        F.lit("").alias("comment"),
    ).orderBy("name")


def write_metafeatures(long: DataFrame, path: str, dataset: str) -> None:
    """One Parquet folder per dataset; names are few, so one file."""
    rows = metafeature_rows(long).withColumn("dataset", F.lit(dataset))
    rows.coalesce(1).write.mode("append").partitionBy("dataset").parquet(path)
