"""A batch of routed questions to prompts: the whole question side as one plan.

Branches are filters of one table: only questions routed to the knowledge base are embedded and
searched. Their candidates are hashed by request once, which serves fusion and diversity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.operators import fusion, prompt, scope, understanding
from askgrid.operators.vector_topk import FILTERS, attach_facts, scope_column, topk_cosine
from askgrid.operators.versions import active_chunks
from askgrid.plans.shared import written

RECALL_BUDGET = 20


@dataclass(frozen=True)
class AskResult:
    """Frames keyed by ``request_id``."""

    context: DataFrame
    """Cited chunks: ``citation_number, chunk_id, rrf_score`` and the chunk facts."""
    prompts: DataFrame
    """``user_prompt, n_sources`` of answerable knowledge questions."""
    direct: DataFrame
    """``model_input`` of questions answered without retrieval."""
    outcomes: DataFrame
    """``outcome`` (answer, direct, clarification, no_context, failed), ``n_sources``,
    ``guidance`` and, for failed ones, ``error_code``."""


def search_questions(questions: DataFrame, chunks: DataFrame, facts: DataFrame,
                     k: int = RECALL_BUDGET) -> DataFrame:
    """Candidates of embedded sub-questions with the facts of their chunks.

    ``questions``: ``request_id, query_index, query_vector`` and scope columns. Vectors are
    searched without the chunk texts; the few candidates fetch these where the chunks lie.
    """
    keyed = questions.withColumn(
        "query_id", F.concat_ws("#", F.col("request_id").cast("string"), "query_index")
    )
    found = topk_cosine(keyed, chunks, k)
    return attach_facts(
        found.join(keyed.select("query_id", "request_id", "query_index"), "query_id"), facts)


def scope_failures(asked: DataFrame, kbs: DataFrame, config: scope.IndexConfig) -> DataFrame:
    """``request_id, error_code`` of requests that name a base that is missing or does not fit.

    A missing base comes before one with another index. Such a request fails as a whole: leaving
    the name out would search bases that were not asked for.
    """
    found = []
    if "unknown_slugs" in asked.columns:
        found.append(asked.where(F.size("unknown_slugs") > 0).select(
            "request_id", F.lit("knowledge_base_not_found").alias("code")))
    if scope_column("knowledge_base_id") in asked.columns:
        found.append(scope.scope_violations(asked, kbs, config).select("request_id", "code"))
    if not found:
        return asked.select("request_id", F.lit(None).cast("string").alias("error_code")).limit(0)
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    missing = F.max(F.col("code") == "knowledge_base_not_found")
    return rows.groupBy("request_id").agg(
        F.when(missing, "knowledge_base_not_found").otherwise(F.min("code")).alias("error_code"))


def prepare_batch(
    requests: DataFrame,
    chunks: DataFrame,
    kbs: DataFrame,
    config: scope.IndexConfig,
    embed: Callable[[DataFrame], DataFrame],
    weights: DataFrame | None = None,
    memory: DataFrame | None = None,
    k: int = RECALL_BUDGET,
    per_document: int = fusion.PER_DOCUMENT,
    limit: int = fusion.CANDIDATE_LIMIT,
    top_k: int = fusion.CONTEXT_TOP_K,
    versions: DataFrame | None = None,
) -> AskResult:
    """Prompts, direct inputs and outcomes for routed requests.

    ``requests``: ``request_id, question, rewritten_question, sub_questions, route, guidance``
    and optional ``slugs``; ``embed`` adds ``query_vector`` to a frame with ``query``. Chunks
    carry ``chunk_id, embedding, document_id, knowledge_base_id, content, content_sha256,
    display_name, source_key`` and optional ``section, page_number``. With ``versions``
    (``version_id, status``), only chunks of active versions are searched. Requests naming a base
    that is missing or has another index end as ``failed``. The selection is written once and
    serves all four frames.
    """
    branches = understanding.split_by_route(requests)
    asked = branches["knowledge_base"]
    if "slugs" in requests.columns:
        resolved = scope.resolve_slugs(asked.select("request_id", "slugs"), kbs)
        asked = asked.drop("slugs").join(
            resolved.select(
                "request_id", "unknown_slugs",
                F.col("knowledge_base_ids").alias(scope_column("knowledge_base_id")),
            ),
            "request_id",
        )
    failures = scope_failures(asked, kbs, config)
    asked = asked.drop("unknown_slugs").join(failures, "request_id", "left_anti")
    if versions is not None:
        chunks = active_chunks(chunks, versions)
    scopes = [scope_column(f) for f in FILTERS if scope_column(f) in asked.columns]
    questions = embed(scope.fan_out(asked.select("request_id", "sub_questions", *scopes)))
    usable = scope.compatible_chunks(chunks, kbs, config)
    candidates = search_questions(questions, usable, chunks.drop("embedding"), k)
    fields = tuple(
        c for c in chunks.columns if c not in ("chunk_id", "embedding", "content")
    )
    fused = fusion.rrf_fuse(candidates, weights, fields=fields)
    selected = fusion.select_candidates(fused, per_document, limit)
    context = written(prompt.select_context(selected, top_k))
    with_text = attach_facts(context, chunks.select("chunk_id", "content"))
    prompts = prompt.build_prompts(with_text, asked, memory)
    kept = requests.select("request_id", "question", "rewritten_question", "route")
    inputs = kept.where(F.col("route") == "system_direct")
    inputs = (
        inputs.join(memory, "request_id", "left") if memory is not None
        else inputs.withColumns({
            "summary": F.lit(None).cast("string"),
            "messages": F.lit(None).cast(
                "array<struct<ordinal:bigint,role:string,content:string>>"),
        })
    )
    sources = context.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_sources"))
    outcome = (
        F.when(F.col("error_code").isNotNull(), "failed")
        .when(F.col("route") == "clarification", "clarification")
        .when(F.col("route") == "system_direct", "direct")
        .when(F.col("n_sources") > 0, "answer")
        .otherwise("no_context")
    )
    outcomes = requests.join(sources, "request_id", "left").join(
        failures, "request_id", "left").select(
        "request_id", outcome.alias("outcome"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "guidance", "error_code",
    )
    return AskResult(context, prompts, prompt.direct_inputs(inputs), outcomes)
