"""Integrity reports: uniqueness, references, row rules, field normalisation.

Every report pre-aggregates before it shuffles, so a hot key costs one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import ANY_CONTROL, strip
from askgrid.operators.admission import base_media_type, basename

# Allowed states.
RUN_STATUSES = ("running", "completed", "no_context", "clarification", "failed", "cancelled")
VERSION_STATUSES = ("building", "active", "failed", "superseded")
_SHA = "^[0-9a-f]{64}$"


def check_unique(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Key values occurring more than once, optionally only among rows matching ``where``."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_fk(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child key values without parent and their row counts; null keys are not references.

    ``keys`` maps child columns to parent columns; several make a composite reference.
    """
    named = list(keys)
    present = [F.col(k).isNotNull() for k in named]
    condition = present[0]
    for more in present[1:]:
        condition = condition & more
    used = child.where(condition).groupBy(*named).agg(F.count(F.lit(1)).alias("n"))
    targets = parent.select(*[F.col(p).alias(c) for c, p in keys.items()]).distinct()
    return used.join(targets, named, "left_anti")


def check_rows(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)`` for every rule a row breaks; an unknown truth value breaks it too."""
    broken = F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ])
    return df.select(*key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def _filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.length(F.trim(F.col(column))) > 0)


def run_rules() -> dict[str, Column]:
    status, route = F.col("status"), F.col("intent_route")
    ended = status.isin("failed", "cancelled")
    return {
        "status_allowed": status.isin(*RUN_STATUSES),
        "finished_at_matches_status": (status == "running") == F.col("finished_at").isNull(),
        "completed_model_result_present": ~status.isin("completed", "clarification")
        | (_filled("model_id") & _filled("finish_reason")),
        "intent_route_matches_status": F.when(
            status == "completed", route.isin("system_direct", "knowledge_base"))
        .when(status == "no_context", route == "knowledge_base")
        .when(status == "clarification", route == "clarification")
        .otherwise(route.isNull()),
        "input_tokens_nonnegative": F.col("input_tokens").isNull() | (F.col("input_tokens") >= 0),
        "output_tokens_nonnegative": F.col("output_tokens").isNull()
        | (F.col("output_tokens") >= 0),
        "error_code_matches_status": F.when(ended, _filled("error_code")).otherwise(
            F.col("error_code").isNull()),
    }


def version_rules() -> dict[str, Column]:
    return {
        "version_number_positive": F.col("version_number") > 0,
        "status_allowed": F.col("status").isin(*VERSION_STATUSES),
        "content_sha256_format": F.col("content_sha256").rlike(_SHA),
    }


def chunk_rules() -> dict[str, Column]:
    return {
        "chunk_index_nonnegative": F.col("chunk_index") >= 0,
        "token_count_positive": F.col("token_count") > 0,
        "content_not_blank": F.length(F.trim(F.col("content"))) > 0,
        "content_sha256_format": F.col("content_sha256").rlike(_SHA),
        "page_number_positive": F.col("page_number").isNull() | (F.col("page_number") > 0),
    }


def message_rules() -> dict[str, Column]:
    return {
        "ordinal_positive": F.col("ordinal") > 0,
        "role_allowed": F.col("role").isin("user", "assistant"),
        "content_not_blank": F.length(F.trim(F.col("content"))) > 0,
    }


def normalize_fields(df: DataFrame) -> DataFrame:
    """Clean ``slug``, ``source_key``, ``filename`` and ``media_type`` where present.

    Adds ``field_violations``, the names of fields that cannot be used.
    """
    out, bad = {}, []
    if "slug" in df.columns:
        slug = F.lower(strip(F.col("slug")))
        out["slug"] = slug
        bad.append(F.when(
            ~(F.length(slug).between(1, 100) & slug.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$")),
            "slug"))
    if "source_key" in df.columns:
        key = strip(F.col("source_key"))
        out["source_key"] = key
        bad.append(F.when(~F.length(key).between(1, 1024) | key.rlike(ANY_CONTROL), "source_key"))
    if "filename" in df.columns:
        name = basename(F.col("filename"))
        out["filename"] = name
        bad.append(F.when(~F.length(name).between(1, 500) | name.isin(".", ".."), "filename"))
    if "media_type" in df.columns:
        out["media_type"] = base_media_type(F.col("media_type"))
    violations = F.filter(F.array(*bad), lambda v: v.isNotNull())
    return df.withColumns({**out, "field_violations": violations})
