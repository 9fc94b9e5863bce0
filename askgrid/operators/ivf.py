"""Approximate top-k over an inverted-list layout, and its recall against the exact result."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from askgrid.functions.lets import let
from askgrid.functions.vectors import as_double, l2_norm
from askgrid.plans.shared import written
from askgrid.operators.vector_topk import _used_filters, cell_topk, scope_column, unit_rows

MAX_LISTS = 65_536
#: Centroids are trained on about so many rows, picked by a hash of their id.
TRAIN_ROWS = 65_536
#: Scores held at a time while lists are picked: rows of a block times lists.
BLOCK_SCORES = 1 << 19


@dataclass(frozen=True)
class IvfIndex:
    """Chunks with a ``list_id`` (write it partitioned by that column) and their centroids."""

    chunks: DataFrame
    centroids: np.ndarray

    @property
    def n_lists(self) -> int:
        return len(self.centroids)


def _unit(column: str):
    return let(as_double(F.col(column)),
               lambda v: let(l2_norm(v), lambda n: F.transform(v, lambda x: x / n)))


def training_sample(chunks: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most about ``rows`` usable rows with their unit vector ``unit``, written once.

    Which rows is decided by a hash of ``chunk_id``, so a repeated task picks the same. Usable are
    vectors with a direction that have the commonest length.
    """
    norm = F.coalesce(l2_norm(F.col("embedding")), F.lit(0.0))
    usable = chunks.select("chunk_id", "embedding").where((norm > 0) & (norm < float("inf")))
    facts = usable.agg(F.count(F.lit(1)).alias("n"),
                       F.mode(F.size("embedding"), True).alias("dimension")).first()
    every = max(1, -(-facts["n"] // rows))
    return written(
        usable.where((F.size("embedding") == F.lit(facts["dimension"]))
                     & (F.pmod(F.xxhash64("chunk_id"), F.lit(every)) == 0))
        .select("chunk_id", _unit("embedding").alias("unit")))


def train_centroids(sample: DataFrame, n_lists: int, seed: int = 7, max_iter: int = 10
                    ) -> np.ndarray:
    """Centroids of the unit vectors of a sample; there may be fewer than ``n_lists``."""
    if not 1 <= n_lists <= MAX_LISTS:
        raise ValueError(f"n_lists must be between 1 and {MAX_LISTS}")
    features = sample.select(array_to_vector("unit").alias("features"))
    model: KMeansModel = KMeans(k=n_lists, seed=seed, maxIter=max_iter).fit(features)
    return np.asarray(model.clusterCenters())


def build_ivf(chunks: DataFrame, n_lists: int, seed: int = 7, max_iter: int = 10) -> IvfIndex:
    """Centroids trained on a bounded sample, and each chunk with the id of its nearest one.

    Training runs in the ML library over partitions; the driver sees only the centroids, whose
    number is checked.
    """
    if n_lists == 1:
        return IvfIndex(chunks.withColumn("list_id", F.lit(0)), np.zeros((1, 1)))
    return assign_lists(chunks, train_centroids(training_sample(chunks), n_lists, seed, max_iter))


def nearest_ids(matrix: np.ndarray, unit: np.ndarray, lists: int) -> np.ndarray:
    """Per row the ids of the ``lists`` most alike rows of ``unit``, best first.

    Similarities are compared at 12 decimals, ties go to the smaller id. Only the wanted lists are
    ordered, and only ``BLOCK_SCORES`` scores exist at a time.
    """
    out = np.empty((len(matrix), lists), np.int32)
    step = max(1, BLOCK_SCORES // len(unit))
    for start in range(0, len(matrix), step):
        scores = matrix[start:start + step] @ unit.T
        np.round(scores, 12, out=scores)
        np.nan_to_num(scores, copy=False, nan=-2.0)
        if lists == 1:
            out[start:start + step, 0] = scores.argmax(axis=1)
            continue
        cut = scores.shape[1] - lists
        floors = np.partition(scores, cut, axis=1)[:, cut]
        rows, ids = np.nonzero(scores >= floors[:, None])
        order = np.lexsort((ids, -scores[rows, ids], rows))
        rows, ids = rows[order], ids[order]
        place = np.arange(rows.size) - np.searchsorted(rows, rows)
        keep = place < lists
        out[start + rows[keep], place[keep]] = ids[keep]
    return out


def _nearest(centroids: np.ndarray, lists: int):
    """A function of vector columns: the ids of the ``lists`` nearest centroids, nearest first.

    A vector that cannot be compared gets the first lists, where the search leaves it out.
    """
    unit = centroids / np.linalg.norm(centroids, axis=1, keepdims=True)

    @F.arrow_udf(ArrayType(IntegerType()))
    def nearest(vectors: pa.Array) -> pa.Array:
        ids = nearest_ids(unit_rows(vectors, unit.shape[1]), unit, lists)
        offsets = np.arange(len(ids) + 1, dtype=np.int32) * lists
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.ravel()))

    return nearest


def assign_lists(chunks: DataFrame, centroids: np.ndarray) -> IvfIndex:
    """An index over ``chunks`` with given centroids: also how new chunks join existing lists."""
    if not 1 <= len(centroids) <= MAX_LISTS:
        raise ValueError(f"the number of centroids must be between 1 and {MAX_LISTS}")
    ids = _nearest(np.asarray(centroids, np.float64), 1)(as_double(F.col("embedding")))
    return IvfIndex(chunks.withColumn("list_id", F.get(ids, F.lit(0))),
                    np.asarray(centroids, np.float64))


def write_ivf(index: IvfIndex, path: str, mode: str = "overwrite") -> None:
    """Store the chunks in one folder per list and the centroids as a table beside them.

    Rows are gathered by list first, so that tasks do not write a file each for every list; a list
    with very many rows is split by adaptive execution. With ``mode="append"`` chunks assigned to
    the stored centroids are added.
    """
    spark = index.chunks.sparkSession
    index.chunks.hint("rebalance", "list_id").write.mode(mode).partitionBy("list_id").parquet(f"{path}/chunks")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "list_id int, centroid array<double>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/centroids")


def read_ivf(spark, path: str) -> IvfIndex:
    """A stored index; only the centroids, at most ``MAX_LISTS``, come to the driver."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
    return IvfIndex(spark.read.parquet(f"{path}/chunks"), np.array([r["centroid"] for r in rows]))


def probe_lists(queries: DataFrame, index: IvfIndex, nprobe: int) -> DataFrame:
    """One row per (query, probed list): the ``nprobe`` nearest centroids."""
    nprobe = min(nprobe, index.n_lists)
    if nprobe == index.n_lists:
        return queries.withColumn(
            "list_id", F.explode(F.sequence(F.lit(0), F.lit(index.n_lists - 1)))
        )
    nearest = _nearest(index.centroids, nprobe)
    return queries.withColumn("list_id", F.explode(nearest(as_double(F.col("query_vector")))))


def probes_for_recall(queries: DataFrame, exact: DataFrame, index: IvfIndex,
                      target: float = 0.9) -> int:
    """The smallest ``nprobe`` that finds at least ``target`` of the rows of ``exact``.

    ``exact`` is the exact result for ``queries``, a sample of the batch to be searched. Each of its
    hits is found from the probe on that reaches its list, so one count per place (at most
    ``MAX_LISTS`` rows) tells the recall of every ``nprobe``. Without hits all lists are probed.
    """
    places = queries.select("query_id", F.posexplode(
        _nearest(index.centroids, index.n_lists)(as_double(F.col("query_vector")))
    ).alias("_place", "list_id"))
    counts = dict(
        exact.select("query_id", "chunk_id")
        .join(index.chunks.select("chunk_id", "list_id"), "chunk_id")
        .join(places, ["query_id", "list_id"])
        .groupBy("_place").agg(F.count(F.lit(1))).collect())
    found = np.cumsum([counts.get(place, 0) for place in range(index.n_lists)])
    if not found[-1]:
        return index.n_lists
    return int(np.argmax(found >= target * found[-1])) + 1


def topk_ivf(queries: DataFrame, index: IvfIndex, k: int = 20, nprobe: int = 8,
             refill: bool = True) -> DataFrame:
    """Exact ranking inside the probed lists; ``nprobe`` is the search effort.

    With ``refill``, queries whose filters leave fewer than k hits in the probed lists search
    all chunks, so a strict filter does not lose hits that exist.
    """
    filters = _used_filters(queries)
    wanted = queries.select("query_id", "query_vector", *[scope_column(f) for f in filters])
    chunks = index.chunks.select("chunk_id", "embedding", "list_id", *filters)
    first = cell_topk(chunks, probe_lists(wanted, index, nprobe), k, bucket="list_id")
    if not refill or nprobe >= index.n_lists:
        return first
    # Read twice below: written once, so that the lists are searched once.
    first = written(first)
    full = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    starved = wanted.join(full, "query_id", "left_anti")
    if starved.isEmpty():
        return first
    again = cell_topk(chunks.drop("list_id"), starved, k)
    return first.join(full.select("query_id"), "query_id", "left_semi").unionByName(again)


def ann_recall(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Per query, the share of its exact top-k found by the approximate search."""
    found = (
        approximate.where(F.col("rank") <= k)
        .select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    )
    truth = exact.where(F.col("rank") <= k).select("query_id", "chunk_id")
    return (
        truth.join(found, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("expected"))
        .withColumn("recall", F.col("hits") / F.col("expected"))
    )


def ranks_contiguous(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose ranks are not 1..n without gaps or repeats."""
    return (
        candidates.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("rank").alias("low"),
            F.max("rank").alias("high"),
            F.count_distinct("rank").alias("distinct_ranks"),
        )
        .where(~((F.col("low") == 1) & (F.col("high") == F.col("n"))
                 & (F.col("distinct_ranks") == F.col("n"))))
    )


__all__ = ["IvfIndex", "ann_recall", "assign_lists", "build_ivf", "nearest_ids", "probe_lists",
           "probes_for_recall", "ranks_contiguous", "read_ivf", "topk_ivf", "train_centroids",
           "training_sample", "write_ivf"]
