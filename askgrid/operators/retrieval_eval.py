"""Retrieval evaluation: labels, document rankings, hit / recall / MRR, comparisons, reports.

Cases carry their ranking (at most ten documents) and gold list as arrays, so judging is a
column expression and every metric is one aggregate with map-side partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.functions.text import is_blank
from askgrid.plans.skew import exact_percentiles

TOP_K = 10
HIT_CUTOFFS = (1, 3, 5, 10)
RECALL_CUTOFFS = (3, 5, 10)
_IDS = "array<string>"


# --- labels and data sets -------------------------------------------------------------------

def check_labels(samples: DataFrame) -> DataFrame:
    """``(query_id, code)`` for samples whose labels contradict each other."""
    required = F.coalesce("expected_doc_ids", F.array().cast(_IDS))
    nice = F.coalesce("expected_doc_ids_nice", F.array().cast(_IDS))
    metrics = F.coalesce("eval_metrics", F.array().cast(_IDS))
    rules = {
        "required_repeated": F.size(F.array_distinct(required)) == F.size(required),
        "nice_repeated": F.size(F.array_distinct(nice)) == F.size(nice),
        "required_and_nice_overlap": F.size(F.array_intersect(required, nice)) == 0,
        "requires_rag_mismatch": F.col("requires_rag") == (F.size(required) > 0),
        "metrics_empty": (F.size(metrics) > 0) & ~F.exists(metrics, is_blank),
        "tool_metric_missing": ~F.coalesce("requires_tool", F.lit(False))
        | F.array_contains(metrics, "tool_routing"),
    }
    codes = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    return samples.select(
        "query_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code")
    )


def check_dataset(samples: DataFrame, expected: dict[str, int],
                  subset: DataFrame | None = None) -> DataFrame:
    """``(check, actual, expected, passed)``: counts, unique ids and subset membership.

    ``expected`` may name ``samples``, ``rag``, ``no_rag`` and ``subset``.
    """
    rag = F.col("requires_rag")
    totals = samples.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(rag).alias("rag"),
        F.count_if(~rag).alias("no_rag"),
    )
    repeated = samples.groupBy("query_id").count().where("count > 1")
    actual = {k: (totals.select(k).scalar(), expected[k])
              for k in ("samples", "rag", "no_rag") if k in expected}
    actual["repeated_ids"] = (repeated.agg(F.count(F.lit(1))).scalar(), 0)
    if subset is not None:
        outside = subset.select("query_id").distinct().join(samples, "query_id", "left_anti")
        again = subset.groupBy("query_id").count().where("count > 1")
        actual["subset_outside"] = (outside.agg(F.count(F.lit(1))).scalar(), 0)
        actual["subset_repeated"] = (again.agg(F.count(F.lit(1))).scalar(), 0)
        if "subset" in expected:
            actual["subset"] = (subset.agg(F.count(F.lit(1))).scalar(), expected["subset"])
    one = samples.sparkSession.range(1)
    named = one.select(*[
        F.struct(F.lit(n).alias("check"), a.alias("actual"),
                 F.lit(e).cast("bigint").alias("expected")).alias(n)
        for n, (a, e) in actual.items()
    ])
    rows = named.select(F.explode(F.array(*actual)).alias("c")).select("c.*")
    return rows.withColumn("passed", F.col("actual") == F.col("expected"))


def missing_gold(samples: DataFrame, documents: DataFrame) -> DataFrame:
    """Labelled documents that the corpus lacks, with the number of samples naming each."""
    lists = [F.coalesce(F.col(c), F.array().cast(_IDS))
             for c in ("expected_doc_ids", "expected_doc_ids_nice")]
    named = (
        samples.select(F.explode(F.concat(*lists)).alias("document_id"))
        .groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    )
    return named.join(documents.select("document_id"), "document_id", "left_anti")


# --- rankings and judgement -----------------------------------------------------------------

def rank_documents(ranked: DataFrame, top_k: int = TOP_K, key: str = "query_id") -> DataFrame:
    """``(query_id, document_id, doc_rank)``: the best ``top_k`` chunks first, then the documents.

    Cutting chunks first means a document seen only below the cut is not ranked.
    """
    first = (
        ranked.where(F.col("rank") <= top_k)
        .groupBy(key, "document_id").agg(F.min("rank").alias("_first"))
    )
    order = Window.partitionBy(key).orderBy("_first")
    return first.withColumn("doc_rank", F.row_number().over(order)).drop("_first")


def rankings(doc_ranks: DataFrame, name: str, key: str = "query_id") -> DataFrame:
    """Document ranks as one array per query; at most ``top_k`` entries each."""
    return doc_ranks.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("doc_rank", "document_id"))),
            lambda s: s["document_id"],
        ).alias(name)
    )


def first_relevant_rank(ranking: Column, required: Column) -> Column:
    """1-based position of the first required document, or null."""
    return F.array_min(
        F.transform(ranking, lambda doc, i: F.when(F.array_contains(required, doc), i + 1))
    )


def judge_cases(cases: DataFrame, ranking: str = "document_ids",
                required: str = "required_document_ids") -> DataFrame:
    """Add ``first_relevant_rank`` and ``missing_document_ids``; a null ranking finds nothing."""
    found = F.coalesce(F.col(ranking), F.array().cast(cases.schema[required].dataType))
    return cases.withColumns({
        "first_relevant_rank": first_relevant_rank(found, F.col(required)),
        "missing_document_ids": F.filter(
            F.col(required), lambda doc: ~F.array_contains(found, doc)
        ),
    })


def retrieval_metrics(cases: DataFrame, ranking: str = "document_ids",
                      required: str = "required_document_ids",
                      by: Sequence[str] = ()) -> DataFrame:
    """Hit, recall and MRR over all cases of each group; failures stay in as misses."""
    gold = F.col(required)
    found = F.coalesce(F.col(ranking), F.array().cast(cases.schema[required].dataType))
    rank = first_relevant_rank(found, gold)
    recalls = {
        k: F.size(F.array_intersect(F.slice(found, 1, k), gold)) / F.size(F.array_distinct(gold))
        for k in RECALL_CUTOFFS
    }
    judged = cases.select(
        *by, rank.alias("_rank"), *[r.alias(f"_r{k}") for k, r in recalls.items()]
    )
    hit = {k: F.avg(F.when(F.col("_rank") <= k, 1.0).otherwise(0.0)) for k in HIT_CUTOFFS}
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        *[h.alias(f"hit_at_{k}") for k, h in hit.items()],
        *[F.avg(f"_r{k}").alias(f"recall_at_{k}") for k in RECALL_CUTOFFS],
        F.avg(F.when(F.col("_rank") <= 10, 1 / F.col("_rank")).otherwise(0.0)).alias("mrr_at_10"),
    )


def win_tie_loss(cases: DataFrame, off: str = "off_rank", on: str = "on_rank",
                 failed_on_loses: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Wins, ties and losses of ``on`` against ``off`` by first relevant rank.

    Two misses tie, except with ``failed_on_loses`` where a missing ``on`` rank always loses.
    """
    a, b = F.col(off), F.col(on)
    tie = a.eqNullSafe(b) & (b.isNotNull() if failed_on_loses else F.lit(True))
    win = b.isNotNull() & (a.isNull() | (b < a))
    outcome = F.when(tie, "tie").when(win, "win").otherwise("loss")
    return cases.select(*by, outcome.alias("_o")).groupBy(*by).agg(
        F.count_if(F.col("_o") == "win").alias("wins"),
        F.count_if(F.col("_o") == "tie").alias("ties"),
        F.count_if(F.col("_o") == "loss").alias("losses"),
    )


def rerank_metrics(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hit@1, Hit@3 and MRR before and after reranking, and wins where a failed answer loses."""

    def metrics(column: str) -> list[Column]:
        rank = F.col(column)
        return [
            F.avg(F.when(rank == 1, 1.0).otherwise(0.0)).alias(f"{column}_hit_at_1"),
            F.avg(F.when(rank <= 3, 1.0).otherwise(0.0)).alias(f"{column}_hit_at_3"),
            F.avg(F.when(rank.isNotNull(), 1 / rank).otherwise(0.0)).alias(f"{column}_mrr_at_10"),
        ]

    off, on = F.col("off_rank"), F.col("on_rank")
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        *metrics("off_rank"),
        *metrics("on_rank"),
        F.count_if(on < off).alias("wins"),
        F.count_if(on == off).alias("ties"),
        F.count_if(on.isNull() | (on > off)).alias("losses"),
    )


def latency_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Interpolated p50 and p95 of a latency column."""
    return exact_percentiles(df, list(by), column, [0.5, 0.95],
                             [f"{column}_p50", f"{column}_p95"])


def retrieval_report(cases: DataFrame) -> DataFrame:
    """One row of totals: successes, failures, rerank calls, tokens and latency percentiles.

    ``cases``: ``retrieval_error_code, rerank_attempted, rerank_error_code,
    rerank_total_tokens, retrieval_latency_ms, rerank_latency_ms``.
    """
    failed = F.col("retrieval_error_code").isNotNull()
    totals = cases.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(~failed).alias("retrieval_successes"),
        F.count_if(failed).alias("retrieval_failures"),
        F.count_if("rerank_attempted").alias("rerank_live_calls"),
        F.count("rerank_error_code").alias("rerank_failures"),
        F.coalesce(F.sum("rerank_total_tokens"), F.lit(0)).alias("rerank_total_tokens"),
    ).withColumn("rerank_successes", F.col("rerank_live_calls") - F.col("rerank_failures"))
    for column in ("retrieval_latency_ms", "rerank_latency_ms"):
        stats = latency_stats(cases, column)
        for suffix in ("p50", "p95"):
            name = f"{column}_{suffix}"
            totals = totals.withColumn(name, stats.select(name).scalar())
    return totals


def merge_reports(off: DataFrame, on: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(merged cases, violations)`` from an OFF and an ON run of the same data set.

    Both: ``query_id, dataset_id, required_document_ids, document_ids, retrieval_error_code,
    retrieval_latency_ms``; ``on`` also ``rerank_attempted, rerank_error_code,
    rerank_latency_ms, rerank_total_tokens``. The merge keeps OFF rankings and retrieval latency
    and everything else from ON.
    """
    a, b = off.alias("a"), on.alias("b")
    both = a.join(b, F.col("a.query_id") == F.col("b.query_id"), "full_outer")
    present = F.col("a.query_id").isNotNull() & F.col("b.query_id").isNotNull()
    code = (
        F.when(F.col("a.query_id").isNull(), "missing_in_off")
        .when(F.col("b.query_id").isNull(), "missing_in_on")
        .when(F.col("a.dataset_id") != F.col("b.dataset_id"), "dataset_differs")
        .when(
            F.col("a.retrieval_error_code").isNotNull()
            | F.col("b.retrieval_error_code").isNotNull(),
            "retrieval_failed",
        )
        .when(
            ~F.col("a.required_document_ids").eqNullSafe(F.col("b.required_document_ids")),
            "required_documents_differ",
        )
    )
    coded = both.withColumn("code", code)
    query = F.coalesce("a.query_id", "b.query_id").alias("query_id")
    violations = coded.where(F.col("code").isNotNull()).select(query, "code")
    merged = coded.where(present & F.col("code").isNull()).select(
        query,
        F.col("b.required_document_ids"),
        F.col("a.document_ids").alias("off_document_ids"),
        F.col("b.document_ids").alias("on_document_ids"),
        F.col("a.retrieval_latency_ms"),
        *[F.col(f"b.{c}") for c in ("rerank_attempted", "rerank_error_code",
                                    "rerank_latency_ms", "rerank_total_tokens")],
    )
    return merged, violations


def build_cases(gold: DataFrame, off: DataFrame, on: DataFrame | None = None) -> DataFrame:
    """Every gold query with its OFF and ON rankings; a query without a ranking keeps null."""
    out = gold.join(rankings(off, "off_document_ids"), "query_id", "left")
    if on is not None:
        out = out.join(rankings(on, "on_document_ids"), "query_id", "left")
    return out


