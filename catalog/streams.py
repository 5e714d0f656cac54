"""Fitted operators on a stream of the event file."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from catalog.decomposition import axes_sql
from catalog.registry import load, query, r6, rounded
from tabloom import Table, get_operator
from tabloom.frame import CLASSIFICATION
from tabloom.functions.linear import affine
from tabloom.session import ensure_checkpoint_dir
from tabloom.streaming.apply import stream_table, transform_stream, write_stream
from tabloom.streaming.pca import IncrementalPca


def scratch(spark) -> str:
    """A new folder beside the checkpoints, where all executors can write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def events(spark, sf) -> Table:
    return Table.of(load(spark, sf, "events"), "event_id", "event_type", ["value", "user_id"], CLASSIFICATION)


@query(
    "stream_standard_scale",
    f"""WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d, avg(user_id) AS mu, stddev_pop(user_id) AS du FROM events)
    SELECT event_id, event_type, {r6('(value - m) / d', 'value_stndrdscale')}, {r6('(user_id - mu) / du', 'user_id_stndrdscale')}
    FROM events, s""",
)
def q_stream_scale(spark, sf):
    """Fitted on the table, applied to the same file read as a stream."""
    t = events(spark, sf)
    fitted = get_operator("standard_scale").fit(t)
    stream = stream_table(spark, sf, t.df.schema, t, pattern="events.parquet")
    out, folder = transform_stream(stream, [fitted]), scratch(spark)
    write_stream(out.df, f"{folder}/out", f"{folder}/progress").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out"))


@query(
    "stream_incremental_pca",
    axes_sql(True, "", 2, "SELECT event_id, value / 100 AS a, user_id / 50 AS b FROM events", "event_id"),
)
def q_stream_pca(spark, sf):
    """Axes from statistics that micro-batches left behind, applied to the table."""
    df = load(spark, sf, "events").select("event_id", "value", "user_id")
    t = Table.of(df, "event_id", None, ["value", "user_id"])
    scaled = t.derive({"a": t.number("value") / 100, "b": t.number("user_id") / 50})
    stream = stream_table(spark, sf, load(spark, sf, "events").schema, t, pattern="events.parquet")
    folder = scratch(spark)
    sink = IncrementalPca(scaled, f"{folder}/statistics", np.zeros(2))
    source = stream.derive({"a": t.number("value") / 100, "b": t.number("user_id") / 50})
    run = (
        source.df.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    m, _, axes = sink.axes(spark)
    x = [scaled.number(n) - F.lit(float(v)) for n, v in zip(scaled.features, m.mean)]
    out = scaled.derive(dict(zip(("a", "b"), affine(x, axes, np.zeros(2)))))
    return rounded(out.df)
