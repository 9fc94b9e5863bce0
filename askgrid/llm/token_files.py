"""Token ids as ORC files that stripes, row indexes and Bloom filters make cheap to read in parts.

Documents are sorted into key ranges, one range per file. Ids are an integer list, which ORC stores
run-length encoded (version 2) under zstd; every ``ROW_INDEX_STRIDE`` rows carry minima and maxima,
and the document id has a Bloom filter, so a lookup skips files, stripes and row groups by metadata
alone. A large file is read by several tasks, stripe by stripe. Each row holds its place inside its
file; the place in the whole corpus is that plus the total of the files before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askgrid.llm.encoding import encoder, slices, tidy

STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1_000
BLOOM_FALSE_POSITIVES = 0.01
FILE_SCHEMA = "doc_id bigint, part bigint, local_start bigint, n_tokens bigint, ids array<int>"


def _encode(file: str, end_id: int):
    """Rows arrive in file order; counts the ids before each inside the file."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(file), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(1)
            for start, size in slices(texts):
                out = enc.ids(texts.slice(start, size))
                ends = out.offsets[1:]
                ids = np.insert(out.ids, ends, end_id).astype(np.int32)
                offsets = out.offsets + np.arange(size + 1)
                lengths = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, size),
                     pa.array(np.full(size, part, np.int64)),
                     pa.array(before + offsets[:-1]),
                     pa.array(lengths),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                before += int(offsets[-1])

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    file: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of every row, each followed by ``end_id``, in ascending ``doc_id`` order.

    Null text counts as empty and gives the end id alone. Rows of one id stay next to each other,
    in the order of their texts; null ids come first. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    (
        rows.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_encode(file, end_id), FILE_SCHEMA)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FALSE_POSITIVES))
        .orc(path)
    )


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Add ``start`` to rows of the files: the ids of all files before, and those before inside."""
    # One row per file; only these pass through one task.
    sizes = spark.read.schema(FILE_SCHEMA).orc(path).groupBy("part").agg(
        F.max(F.col("local_start") + F.col("n_tokens")).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, "part").withColumn("start", F.col("_before") + F.col("local_start"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files with ``start``: how many ids of all documents lie before each one's first."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return _with_start(rows, spark, path).select("doc_id", "start", "n_tokens", "ids")


def find_documents(spark: SparkSession, path: str, wanted: Column) -> DataFrame:
    """Rows whose ``doc_id`` meets ``wanted``, which the reader checks against the metadata."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(wanted).select(
        "doc_id", "n_tokens", "ids")


@tidy
def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(4)
        offsets = ids.offsets.to_numpy()
        held = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
        sums = [zlib.crc32(held[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(4)), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_file_report(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files."""
    # Ids are summed up where they are read; only the small rows meet the offsets.
    sums = spark.read.schema(FILE_SCHEMA).orc(path).mapInArrow(
        _checksums, "doc_id bigint, part bigint, local_start bigint, n_tokens bigint, "
        "ids_crc32 bigint")
    return _with_start(sums, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
