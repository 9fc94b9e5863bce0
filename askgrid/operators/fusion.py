"""Reciprocal-rank fusion of the lists of one request, and the diversity rules after it.

Every list has at most ``k`` candidates and a request at most three lists, so each group below
is small by construction however many requests there are; all steps partition by request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
PER_DOCUMENT = 2
CANDIDATE_LIMIT = 40
CONTEXT_TOP_K = 10
# Columns that describe the chunk, not its occurrence in a list.
CHUNK_FIELDS = ("document_id", "content_sha256")


def fusion_order(*first: str) -> list:
    """Total order of fused candidates, after optional leading columns."""
    return [
        *[F.col(c) for c in first],
        F.col("rrf_score").desc(),
        F.col("best_rank"),
        F.col("best_similarity").desc(),
        F.col("first_query_index"),
        F.col("chunk_id").cast("string"),
    ]


def rrf_fuse(candidates: DataFrame, weights: DataFrame | None = None, k: int = RRF_K,
             fields: tuple[str, ...] = CHUNK_FIELDS) -> DataFrame:
    """One row per (request, chunk): score, hit count, best rank and similarity, ``fields``.

    The one exchange, on ``request_id``, also serves the windows of ``select_candidates``.

    ``weights`` has ``request_id, query_index, weight``; without it every list counts 1. Terms
    are added in list order, so equal inputs give equal floats. ``first_query_index`` is the
    list of the occurrence with the smallest (rank, -similarity, query_index).
    """
    if weights is None:
        weighted = candidates.withColumn("weight", F.lit(1.0))
    else:
        weighted = candidates.join(weights, ["request_id", "query_index"], "left")
    term = F.struct("query_index", (F.col("weight") / (F.lit(k) + F.col("rank"))).alias("term"))
    occurrence = F.struct(
        F.col("rank"), (-F.col("similarity")).alias("away"), F.col("query_index")
    )
    return (
        weighted.repartition("request_id")
        .groupBy("request_id", "chunk_id")
        .agg(
            F.aggregate(
                F.array_sort(F.collect_list(term)), F.lit(0.0), lambda acc, t: acc + t["term"]
            ).alias("rrf_score"),
            F.count(F.lit(1)).alias("query_hit_count"),
            F.min("rank").alias("best_rank"),
            F.max("similarity").alias("best_similarity"),
            F.min(occurrence).getField("query_index").alias("first_query_index"),
            *[F.min_by(f, occurrence).alias(f) for f in fields],
        )
    )


def dedup_content(fused: DataFrame) -> DataFrame:
    """Keep the best fused chunk per (request, content hash)."""
    best = Window.partitionBy("request_id", "content_sha256").orderBy(*fusion_order())
    return fused.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def cap_per_document(fused: DataFrame, n: int = PER_DOCUMENT) -> DataFrame:
    """Keep the ``n`` best chunks per (request, document)."""
    best = Window.partitionBy("request_id", "document_id").orderBy(*fusion_order())
    return fused.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n).drop("_n")


def limit_candidates(fused: DataFrame, n: int = CANDIDATE_LIMIT) -> DataFrame:
    """Number the survivors 1.. by fusion order per request and keep the first ``n``."""
    best = Window.partitionBy("request_id").orderBy(*fusion_order())
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def select_candidates(fused: DataFrame, per_document: int = PER_DOCUMENT,
                      limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Content dedup, then document cap, then limit.

    A chunk removed by the document cap does not bring back its duplicate: the duplicate was
    dropped first. All three windows are satisfied by the partitioning of ``rrf_fuse``.
    """
    return limit_candidates(cap_per_document(dedup_content(fused), per_document), limit)


def fusion_counts(candidates: DataFrame, fused: DataFrame, selected: DataFrame) -> DataFrame:
    """Raw, unique chunk, unique content and selected counts per request."""
    raw = candidates.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("raw_candidates"),
        F.count_distinct("chunk_id").alias("unique_chunks"),
        F.count_distinct("content_sha256").alias("unique_contents"),
    )
    kept = selected.groupBy("request_id").agg(F.count(F.lit(1)).alias("selected"))
    return raw.join(kept, "request_id", "left").withColumn(
        "selected", F.coalesce("selected", F.lit(0))
    )


def fusion_violations(candidates: DataFrame, weights: DataFrame,
                      fields: tuple[str, ...] = CHUNK_FIELDS,
                      config: str | None = None) -> DataFrame:
    """``(request_id, code, n)`` for inputs that fusion must not silently accept."""

    def broken(groups: DataFrame, code: str) -> DataFrame:
        return groups.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "code", F.lit(code)
        )

    repeated = (
        candidates.groupBy("request_id", "query_index", "chunk_id").count().where("count > 1")
    )
    metadata = (
        candidates.groupBy("request_id", "chunk_id")
        .agg(F.count_distinct(F.struct(*fields)).alias("d"))
        .where("d > 1")
    )
    two_texts = (
        candidates.groupBy("request_id", "content_sha256")
        .agg(F.count_distinct("content").alias("d"))
        .where("d > 1")
    )
    lists = candidates.select("request_id", "query_index").distinct()
    bad_weight = lists.join(weights, ["request_id", "query_index"], "left").where(
        F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") <= 0)
        | (F.col("weight") == float("inf"))
    )
    out = (
        broken(repeated, "chunk_repeated_in_list")
        .unionByName(broken(metadata, "metadata_differs"))
        .unionByName(broken(two_texts, "hash_with_two_texts"))
        .unionByName(broken(bad_weight, "weight_invalid"))
    )
    if config is not None:
        mixed = (
            candidates.groupBy("request_id").agg(F.count_distinct(config).alias("d")).where("d > 1")
        )
        out = out.unionByName(broken(mixed, "index_configuration_mixed"))
    return out.select("request_id", "code", "n")


def no_context(requests: DataFrame, fused: DataFrame) -> DataFrame:
    """Requests for which nothing was found."""
    return requests.join(
        fused.select("request_id").distinct(), "request_id", "left_anti"
    ).withColumn("outcome", F.lit("no_context"))
