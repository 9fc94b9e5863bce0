"""Intent evaluation: judgement, slice accuracy, confusion, threshold replay, failure buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.lets import let
from askgrid.functions.routes import ROUTES, decide, score_profile

DIRECT, KNOWLEDGE, CLARIFY = ROUTES


def expected_route(requires_rag: Column) -> Column:
    return F.when(requires_rag, KNOWLEDGE).otherwise(DIRECT)


def judge_intents(samples: DataFrame, decisions: DataFrame) -> DataFrame:
    """Samples with decisions: expected and actual route, and whether the case is correct.

    A degraded call is never correct, even where the fallback route is the expected one.
    ``decisions``: ``query_id, route, reason, degradation_reason`` and any score columns.
    """
    return (
        samples.join(decisions, "query_id")
        .withColumn("expected_route", expected_route(F.col("requires_rag")))
        .withColumnRenamed("route", "actual_route")
        .withColumn(
            "correct",
            F.col("degradation_reason").isNull()
            & (F.col("actual_route") == F.col("expected_route")),
        )
    )


def _accuracy() -> list[Column]:
    n, good = F.count(F.lit(1)), F.count_if("correct")
    return [n.alias("sample_count"), good.alias("correct_count"), (good / n).alias("accuracy")]


def intent_accuracy(cases: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Accuracy overall, with and without retrieval, per first-level intent, per named slice.

    One pass of grouping sets; ``members`` adds slices as ``(query_id, slice)`` rows.
    """
    rag = F.col("expected_route") == KNOWLEDGE
    rows = cases.select(rag.alias("_rag"), "intent_l1", "correct")
    sets = rows.groupingSets([[], ["_rag"], ["intent_l1"]], "_rag", "intent_l1").agg(
        F.grouping_id("_rag", "intent_l1").alias("_g"), *_accuracy()
    )
    name = (
        F.when(F.col("_g") == 3, "overall")
        .when((F.col("_g") == 1) & F.col("_rag"), "rag")
        .when(F.col("_g") == 1, "no_rag")
        .otherwise(F.concat(F.lit("intent_l1="), "intent_l1"))
    )
    out = sets.select(name.alias("slice"), "sample_count", "correct_count", "accuracy")
    if members is not None:
        named = (
            cases.join(members.select("query_id", "slice"), "query_id")
            .groupBy("slice").agg(*_accuracy())
        )
        out = out.unionByName(named)
    return out


def confusion(cases: DataFrame) -> DataFrame:
    """Counts for all nine (expected, actual) pairs, zeros included."""
    counts = cases.groupBy("expected_route", "actual_route").agg(F.count(F.lit(1)).alias("_n"))
    routes = F.array(*[F.lit(r) for r in ROUTES])
    grid = (
        cases.sparkSession.range(1)
        .select(F.explode(routes).alias("expected_route"))
        .select("expected_route", F.explode(routes).alias("actual_route"))
    )
    return grid.join(counts, ["expected_route", "actual_route"], "left").select(
        "expected_route", "actual_route", F.coalesce("_n", F.lit(0)).alias("n")
    )


def replay_thresholds(cases: DataFrame, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """Accuracy and route counts for each ``(threshold, margin)``, without new model calls.

    A decision depends only on the best score, its lead and its route, so cases are counted per
    such profile first; the literal grid then multiplies profiles, not cases. Degraded cases
    keep their route and stay wrong.
    """
    scores = {r: F.col(f"{r}_score") for r in ROUTES}
    degraded = F.col("degradation_reason").isNotNull()
    profiles = (
        cases.select(
            F.when(~degraded, score_profile(scores)).alias("_p"),
            F.when(degraded, F.col("actual_route")).alias("_kept"),
            "expected_route",
        )
        .groupBy("_p", "_kept", "expected_route")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    points = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(m)).alias("margin"))
        for t, m in grid
    ])
    replayed = profiles.withColumn("_g", F.explode(points)).withColumn(
        "_route",
        F.coalesce(
            F.col("_kept"),
            let(F.col("_p"), lambda p: decide(p["top"], p["gap"], p["top_route"],
                                              F.col("_g.threshold"), F.col("_g.margin")))["route"],
        ),
    )
    good = F.col("_kept").isNull() & (F.col("_route") == F.col("expected_route"))
    rag = F.col("expected_route") == KNOWLEDGE

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    return (
        replayed.groupBy("_g.threshold", "_g.margin")
        .agg(
            F.sum("_n").alias("sample_count"),
            total(good).alias("correct_count"),
            total(good & rag).alias("rag_correct"),
            total(good & ~rag).alias("no_rag_correct"),
            *[total(F.col("_route") == r).alias(f"to_{r}") for r in ROUTES],
        )
        .withColumn("accuracy", F.col("correct_count") / F.col("sample_count"))
    )


def over_retrieval() -> Column:
    return (F.col("expected_route") == DIRECT) & (F.col("actual_route") == KNOWLEDGE)


def under_retrieval() -> Column:
    return (F.col("expected_route") == KNOWLEDGE) & (F.col("actual_route") == DIRECT)


def route_errors(cases: DataFrame, by: Sequence[str] = (), failures_only: bool = True
                 ) -> DataFrame:
    """Over-retrieval, under-retrieval and clarification counts, over failures or all cases."""
    rows = cases.where(~F.col("correct")) if failures_only else cases
    return rows.groupBy(*by).agg(
        F.count_if(over_retrieval()).alias("over_retrieval"),
        F.count_if(under_retrieval()).alias("under_retrieval"),
        F.count_if(F.col("actual_route") == CLARIFY).alias("clarification"),
    )


BUCKET = ("intent_l1", "intent_l2", "expected_route", "actual_route", "reason")


def failure_buckets(cases: DataFrame) -> DataFrame:
    """Number of failures per (intent levels, expected, actual, reason).

    The ids of a bucket stay rows (``failure_members``): a bucket may hold most of the failures.
    """
    return cases.where(~F.col("correct")).groupBy(*BUCKET).agg(
        F.count(F.lit(1)).alias("sample_count")
    )


def failure_members(cases: DataFrame) -> DataFrame:
    """One row per failed case with the bucket it belongs to; write it partitioned by bucket."""
    return cases.where(~F.col("correct")).select(*BUCKET, "query_id")


def failure_totals(cases: DataFrame) -> DataFrame:
    """Failures by first-level intent and by reason, in one pass."""
    failed = cases.where(~F.col("correct")).select(
        F.explode(F.array(
            F.struct(F.lit("intent_l1").alias("dimension"), F.col("intent_l1").alias("value")),
            F.struct(F.lit("reason").alias("dimension"), F.col("reason").alias("value")),
        )).alias("t")
    )
    return failed.groupBy("t.dimension", "t.value").agg(F.count(F.lit(1)).alias("n"))
