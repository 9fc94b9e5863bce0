"""Snapshot tables: every write is a new folder, readers take the newest finished one.

A snapshot counts only once its ``_SUCCESS`` marker exists, so a failed or running write is
never read and a table switches in one step. Works on any Hadoop file system.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, jvm


def snapshot_ids(spark: SparkSession, path: str, finished: bool = True) -> list[int]:
    """Ids of the (finished) snapshots of a table, ascending."""
    fs, target, jvm = _folder(spark, path)
    if not fs.exists(target):
        return []
    ids = []
    for status in fs.listStatus(target):
        name = status.getPath().getName()
        if name.startswith("snapshot="):
            marker = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if not finished or fs.exists(marker):
                ids.append(int(name.split("=", 1)[1]))
    return sorted(ids)


def read_snapshot(spark: SparkSession, path: str, schema: str | None = None,
                  snapshot: int | None = None) -> DataFrame:
    """Newest (or given) snapshot; an empty table of ``schema`` before the first one."""
    ids = snapshot_ids(spark, path)
    if snapshot is None:
        if not ids:
            if schema is None:
                raise FileNotFoundError(path)
            return spark.createDataFrame([], schema)
        snapshot = ids[-1]
    return spark.read.parquet(f"{path}/snapshot={snapshot}")


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                   snapshot: int | None = None) -> int:
    """Write ``df`` as the next snapshot and return its id; an existing id is left untouched.

    Giving ``snapshot`` makes a repeated write of the same batch a no-op.
    """
    spark = df.sparkSession
    if snapshot is None:
        every = snapshot_ids(spark, path, finished=False)
        snapshot = every[-1] + 1 if every else 1
    elif snapshot in snapshot_ids(spark, path):
        return snapshot
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/snapshot={snapshot}")
    return snapshot


def write_report(df: DataFrame, path: str) -> None:
    """Write an aggregated report as JSON lines."""
    df.write.mode("overwrite").json(path)
