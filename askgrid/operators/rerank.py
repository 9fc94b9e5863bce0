"""Apply a reranker's answer, or fall back to fusion order with a stable reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.operators.fusion import CONTEXT_TOP_K

# Reasons a reordering is not used.
DISABLED, UNAVAILABLE, TIMEOUT, PROTOCOL = (
    "disabled", "provider_unavailable", "timeout", "protocol",
)


def apply_rerank(selected: DataFrame, results: DataFrame, status: DataFrame,
                 top_k: int = CONTEXT_TOP_K) -> DataFrame:
    """Final ``rank`` per request, with the ``degradation_reason`` where fusion order was kept.

    ``results``: ``request_id, position (1..), original_index (0-based), chunk_id, score`` as
    the provider sent them; ``status``: ``request_id, status`` with ``ok`` or a reason above.
    One bad item rejects the whole reordering of its request.
    """
    indexed = selected.withColumn("original_index", (F.col("rank") - 1).cast("bigint"))
    sizes = indexed.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    own = indexed.select("request_id", "original_index", F.col("chunk_id").alias("_own"))
    by_position = Window.partitionBy("request_id").orderBy("position")
    checked = (
        results.withColumn("_previous", F.lag("score").over(by_position))
        .join(own, ["request_id", "original_index"], "left")
        .withColumn(
            "_ok",
            F.col("_own").isNotNull()
            & F.col("_own").eqNullSafe(F.col("chunk_id"))
            & F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False))
            & ~F.isnan("score")
            & (F.col("_previous").isNull() | (F.col("score") <= F.col("_previous"))),
        )
        .groupBy("request_id")
        .agg(
            F.count(F.lit(1)).alias("_items"),
            F.count_distinct("original_index").alias("_indexes"),
            F.bool_and("_ok").alias("_all_ok"),
        )
    )
    verdict = (
        sizes.join(status, "request_id", "left")
        .join(checked, "request_id", "left")
        .select(
            "request_id",
            F.when(F.coalesce("status", F.lit(DISABLED)) != "ok",
                   F.coalesce("status", F.lit(DISABLED)))
            .when(
                F.coalesce(F.col("_all_ok"), F.lit(False))
                & (F.col("_items") == F.least(F.lit(top_k), F.col("_n")))
                & (F.col("_indexes") == F.col("_items")),
                F.lit(None),
            )
            .otherwise(PROTOCOL)
            .alias("degradation_reason"),
        )
    )
    provider = results.select("request_id", "original_index", "position").groupBy(
        "request_id", "original_index"
    ).agg(F.min("position").alias("_position"))
    final = Window.partitionBy("request_id").orderBy("_place")
    kept = F.when(F.col("degradation_reason").isNull(), F.col("_position")).otherwise(
        F.col("original_index") + 1
    )
    return (
        indexed.withColumnRenamed("rank", "fusion_rank")
        .join(verdict, "request_id")
        .join(provider, ["request_id", "original_index"], "left")
        .withColumn("_place", kept)
        .where(F.col("_place").isNotNull())
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= top_k)
        .drop("_position", "_place", "original_index")
    )


def lexical_score(query: Column, passage: Column) -> Column:
    """Share of the distinct query words found in the passage; 0 for an empty query."""

    def words(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))

    wanted = words(query)
    return F.coalesce(
        F.size(F.array_intersect(wanted, words(passage))) / F.nullif(F.size(wanted), F.lit(0)),
        F.lit(0.0),
    )


def score_pairs(pairs: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score,
                top_n: int = CONTEXT_TOP_K) -> DataFrame:
    """Score ``(request_id, original_index, query, passage)`` and keep the ``top_n`` per request.

    ``scorer`` is a column function; wrap a model as an iterator pandas UDF of (query, passage).
    Score descending, then candidate position.
    """
    best = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "original_index")
    return (
        pairs.withColumn("score", scorer(F.col("query"), F.col("passage")))
        .withColumn("position", F.row_number().over(best))
        .where(F.col("position") <= top_n)
    )


__all__ = ["DISABLED", "PROTOCOL", "TIMEOUT", "UNAVAILABLE", "apply_rerank", "lexical_score",
           "score_pairs"]
