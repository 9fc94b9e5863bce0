"""Shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the session names in ``spark.checkpoint.dir``.

    A machine-local folder is made only where that is unset and the session itself is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/askgrid-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to a shared table and reading that back."""
    target = folder or shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition a scan by ``key`` only if it has fewer splits than the cluster has cores.

    Meant for work done inside the row, where one large input split would keep one core busy. A
    large table has more splits than cores and is left alone, so nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
