"""Fitted operators on streams.

A fitted row-wise operator is a set of column expressions over literals, so it
applies to a streaming DataFrame unchanged and keeps no state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from tabloom.frame import Table
from tabloom.operators.base import Fitted


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, like: Table, pattern: str = "*.parquet", files: int = 1) -> Table:
    """A Parquet folder as a stream with the roles of ``like``; new files are new rows."""
    df = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )
    return replace(like, df=df)


def transform_stream(t: Table, fitted: Sequence[Fitted]) -> Table:
    for f in fitted:
        t = f.transform(t)
    return t


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet; the checkpoint folder must be shared by the cluster."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
