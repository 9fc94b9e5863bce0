"""Search scopes: normalisation, slug resolution, index compatibility, sub-question fan-out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import ANY_CONTROL, strip
from askgrid.operators.vector_topk import FILTERS, scope_column

# The most values each filter list may hold.
SCOPE_LIMITS = {
    "knowledge_base_id": 100,
    "document_id": 1000,
    "document_format": 5,
    "parser_name": 100,
    "section": 100,
    "page_number": 1000,
}
# The longest value of the two text filters.
TEXT_LENGTHS = {"parser_name": 100, "section": 500}
# Known document formats.
FORMATS = ("csv", "docx", "markdown", "pdf", "plain_text")


@dataclass(frozen=True)
class IndexConfig:
    """Identity of an embedding index; two indexes compare only if all four fields agree."""

    model_id: str
    revision: str
    dimension: int
    normalized: bool = True

    def matches(self) -> Column:
        return (
            F.col("embedding_model_id").eqNullSafe(self.model_id)
            & F.col("embedding_model_revision").eqNullSafe(self.revision)
            & F.col("embedding_dimension").eqNullSafe(self.dimension)
            & F.col("embedding_normalized").eqNullSafe(self.normalized)
        )


def _bad_text(longest: int):
    return lambda v: (F.length(v) == 0) | (F.length(v) > longest) | v.rlike(ANY_CONTROL)


def normalize_scope(requests: DataFrame) -> DataFrame:
    """Dedupe the filter lists keeping first positions, trim text ones; add ``violations``."""
    found, clean = [], {}
    for attribute in FILTERS:
        name = scope_column(attribute)
        if name not in requests.columns:
            continue
        values = F.coalesce(F.col(name), F.array().cast(requests.schema[name].dataType))
        if attribute in TEXT_LENGTHS:
            values = F.transform(values, strip)
            bad = F.exists(values, _bad_text(TEXT_LENGTHS[attribute]))
            found.append(F.when(bad, F.lit(f"{attribute}_value")))
        elif attribute == "page_number":
            found.append(F.when(F.exists(values, lambda v: v < 1), F.lit("page_number_value")))
        elif attribute == "document_format":
            bad = F.exists(values, lambda v: ~v.isin(*FORMATS))
            found.append(F.when(bad, F.lit("document_format_value")))
        values = F.array_distinct(values)
        found.append(F.when(F.size(values) > SCOPE_LIMITS[attribute], F.lit(f"{attribute}_count")))
        clean[name] = values
    names = F.filter(F.array(*found), lambda v: v.isNotNull()) if found else F.array().cast(
        "array<string>")
    return requests.withColumns({**clean, "violations": names})


def resolve_slugs(requests: DataFrame, kbs: DataFrame) -> DataFrame:
    """Turn ``slugs`` into ``knowledge_base_ids`` in the given order; list unknown slugs."""
    wanted = requests.select("request_id", F.posexplode("slugs").alias("pos", "slug"))
    known = kbs.select("slug", "knowledge_base_id")
    found = wanted.join(known, "slug", "left")
    per_request = found.groupBy("request_id").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("knowledge_base_id").isNotNull(),
                                  F.struct("pos", "knowledge_base_id")))
        ).alias("_ids"),
        F.array_sort(
            F.collect_list(F.when(F.col("knowledge_base_id").isNull(), F.struct("pos", "slug")))
        ).alias("_unknown"),
    )
    return requests.join(
        per_request.select(
            "request_id",
            F.transform("_ids", lambda s: s["knowledge_base_id"]).alias("knowledge_base_ids"),
            F.transform("_unknown", lambda s: s["slug"]).alias("unknown_slugs"),
        ),
        "request_id",
        "left",
    )


def incompatible_kbs(kbs: DataFrame, config: IndexConfig) -> DataFrame:
    """Knowledge bases whose stored index identity differs from ``config``."""
    return kbs.where(~config.matches())


def compatible_chunks(chunks: DataFrame, kbs: DataFrame, config: IndexConfig) -> DataFrame:
    """Chunks searchable with ``config``: a semi join that adds no column and no row."""
    return chunks.join(kbs.where(config.matches()), "knowledge_base_id", "left_semi")


def scope_violations(requests: DataFrame, kbs: DataFrame, config: IndexConfig) -> DataFrame:
    """Directed scopes naming a missing or incompatible knowledge base.

    A request with an empty list searches all compatible knowledge bases and is never a
    violation; naming one that does not fit is an error.
    """
    name = scope_column("knowledge_base_id")
    asked = requests.select("request_id", F.explode(name).alias("knowledge_base_id")).distinct()
    state = kbs.select(
        "knowledge_base_id",
        F.when(config.matches(), "ok").otherwise("index_configuration_mismatch").alias("_state"),
    )
    return (
        asked.join(state, "knowledge_base_id", "left")
        .withColumn("code", F.coalesce("_state", F.lit("knowledge_base_not_found")))
        .where(F.col("code") != "ok")
        .select("request_id", "knowledge_base_id", "code")
    )


def scope_predicate(
    **allowed: list,
) -> Column:
    """One literal scope as a pushable filter: AND across attributes, IN within one."""
    unknown = set(allowed) - set(FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    condition = F.lit(True)
    for attribute, values in allowed.items():
        if values:
            condition = condition & F.col(attribute).isin(list(values))
    return condition


def scoped_chunks(chunks: DataFrame, kbs: DataFrame, config: IndexConfig,
                  **allowed: list) -> DataFrame:
    """Compatible chunks under one literal scope; the filter reaches the file scan."""
    return compatible_chunks(chunks.where(scope_predicate(**allowed)), kbs, config)


def fan_out(requests: DataFrame) -> DataFrame:
    """One row per sub-question: ``(request_id, query_index, query)``, same scope columns."""
    rest = [c for c in requests.columns if c not in ("request_id", "sub_questions")]
    return requests.select(
        "request_id", F.posexplode("sub_questions").alias("query_index", "query"), *rest
    )


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """Candidates breaking a value rule, or sitting in a list whose ranks are not 1..n."""
    keys = ["request_id", "query_index"]
    gaps = (
        candidates.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("rank").alias("low"),
            F.max("rank").alias("high"),
            F.count_distinct("rank").alias("ranks"),
        )
        .where((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("ranks") != F.col("n")))
        .select(*keys, F.lit(None).cast(candidates.schema["chunk_id"].dataType).alias("chunk_id"),
                F.lit("ranks_not_contiguous").alias("code"))
    )
    distance, similarity = F.col("cosine_distance"), F.col("similarity")
    finite = ~(
        F.isnan(distance) | F.isnan(similarity)
        | (F.abs(distance) == F.lit(float("inf"))) | (F.abs(similarity) == F.lit(float("inf")))
    )
    rules = {
        "rank_positive": F.col("rank") >= 1,
        "finite": finite,
        "distance_range": distance.between(-1e-6, 2.000001),
        "similarity_consistent": F.abs(similarity - (1.0 - distance)) <= F.greatest(
            F.lit(1e-9), 1e-9 * F.greatest(F.abs(similarity), F.abs(1.0 - distance))),
        "content_sha256_format": F.col("content_sha256").rlike("^[0-9a-f]{64}$"),
        "content_not_blank": F.length(strip(F.col("content"))) > 0,
    }
    codes = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    rows = candidates.select(
        *keys, "chunk_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code")
    )
    return rows.unionByName(gaps)
