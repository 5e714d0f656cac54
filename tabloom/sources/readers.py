"""Reading tables and folders of tables."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabloom.frame import CLASSIFICATION, Table


def read_frame(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = False
) -> DataFrame:
    """CSV (header row) or Parquet by extension.

    Without a schema the types of a CSV are inferred, which reads it twice; give one
    for large files. ``multiline`` allows line feeds inside quotes and then reads a file
    in one task; without it files are split.
    """
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def read_table(
    spark: SparkSession,
    path: str,
    key: str | Sequence[str],
    label: str | None = None,
    features: Sequence[str] | None = None,
    schema: T.StructType | None = None,
    task: str = CLASSIFICATION,
    multiline: bool = False,
) -> Table:
    """A table with roles; without ``label`` the last column is the target."""
    df = read_frame(spark, path, schema, multiline)
    return Table.of(df, key, label or df.columns[-1], features, task)


def dataset_name(path: str) -> str:
    """File name up to its first dot."""
    return PurePosixPath(path).name.split(".")[0]


def read_dataset_paths(spark: SparkSession, paths: Sequence[str], **roles) -> dict[str, Table]:
    """One lazy table per path, keyed by dataset name; schemas may differ."""
    return {dataset_name(p): read_table(spark, p, **roles) for p in paths}


def read_dataset_dir(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of one schema as one frame with a ``dataset`` column from the file name."""
    frame = read_frame(spark, pattern)
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return frame.select(F.element_at(F.split(file, r"\."), 1).alias("dataset"), "*")


def spread(df: DataFrame) -> DataFrame:
    """Give a frame that is read as one file split, and so is small, one task per core.

    Meant for scans that feed heavy per-row work. A scan of several splits is left
    alone; ``spark.sql.files.maxPartitionBytes`` sets their size.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else df
