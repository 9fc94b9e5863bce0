"""Batch embedding through a port, and validation of the vectors that come back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.functions.vectors import hash_vector, vector_violation

BATCH_SIZE = 16


def embed(df: DataFrame, text: str = "content", dimension: int = 768, normalized: bool = True,
          load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
          batch_size: int = BATCH_SIZE, output: str = "embedding") -> DataFrame:
    """Add ``output``; ``load`` returns the model's encode function, once per Python worker.

    Without ``load`` the deterministic hash embedder is used, which runs inside the JVM.
    """
    if load is None:
        vector = hash_vector(F.col(text), dimension, normalized).cast("array<float>")
        return df.withColumn(output, vector)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            values = texts.tolist()
            rows: list = []
            for start in range(0, len(values), batch_size):
                rows.extend(np.asarray(encode(values[start:start + batch_size]), np.float32))
            yield pd.Series(rows)

    return df.withColumn(output, run(F.col(text)))


def validate_vectors(df: DataFrame, dimension: int, normalized: bool = True,
                     column: str = "embedding") -> DataFrame:
    """Add ``violation``: code of the first rule the vector breaks, else null."""
    return df.withColumn("violation", vector_violation(F.col(column), dimension, normalized))


def vector_count_violations(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Documents whose number of vectors differs from their number of chunks."""
    want = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"))
    have = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("vectors"))
    return want.join(have, key, "full_outer").fillna(0, ["chunks", "vectors"]).where(
        F.col("chunks") != F.col("vectors")
    )
