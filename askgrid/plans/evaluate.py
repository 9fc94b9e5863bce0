"""Whole evaluation runs as plans: retrieval with and without reranking, and intents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.operators import intent_eval, retrieval_eval


@dataclass(frozen=True)
class RetrievalEvaluation:
    cases: DataFrame
    metrics: DataFrame
    comparison: DataFrame | None


def evaluate_retrieval(gold: DataFrame, off: DataFrame, on: DataFrame | None = None,
                       top_k: int = retrieval_eval.TOP_K) -> RetrievalEvaluation:
    """Cases, metrics per ranking and win / tie / loss from ranked chunks.

    ``gold``: ``query_id, required_document_ids``; ``off`` and ``on``: ``query_id, rank,
    document_id`` of the chunks before and after reranking. Queries without a ranking stay in
    the denominator as misses.
    """
    ranked = [retrieval_eval.rank_documents(df, top_k) for df in (off, on) if df is not None]
    cases = retrieval_eval.build_cases(gold, *ranked)
    names = ["off", "on"][: len(ranked)]
    metrics = None
    for name in names:
        part = retrieval_eval.retrieval_metrics(cases, f"{name}_document_ids").withColumn(
            "ranking", F.lit(name))
        metrics = part if metrics is None else metrics.unionByName(part)
    required = F.col("required_document_ids")
    judged = cases.withColumns({
        f"{name}_rank": retrieval_eval.first_relevant_rank(
            F.col(f"{name}_document_ids"), required)
        for name in names
    })
    comparison = retrieval_eval.win_tie_loss(judged) if on is not None else None
    return RetrievalEvaluation(judged, metrics, comparison)


@dataclass(frozen=True)
class IntentEvaluation:
    cases: DataFrame
    accuracy: DataFrame
    confusion: DataFrame
    errors: DataFrame
    buckets: DataFrame
    replay: DataFrame | None


def evaluate_intents(samples: DataFrame, decisions: DataFrame,
                     members: DataFrame | None = None,
                     grid: Sequence[tuple[float, float]] = ()) -> IntentEvaluation:
    """All intent reports of one run; ``grid`` adds the threshold replay."""
    cases = intent_eval.judge_intents(samples, decisions)
    return IntentEvaluation(
        cases,
        intent_eval.intent_accuracy(cases, members),
        intent_eval.confusion(cases),
        intent_eval.route_errors(cases),
        intent_eval.failure_buckets(cases),
        intent_eval.replay_thresholds(cases, grid) if grid else None,
    )
