"""Create knowledge bases from a batch of drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import strip
from askgrid.operators.integrity import normalize_fields
from askgrid.operators.scope import IndexConfig
from askgrid.plans.skew import HOT_ROWS, attach_per_key


def create_knowledge_bases(existing: DataFrame, drafts: DataFrame, config: IndexConfig,
                           hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(created, rejects)`` from ``draft_seq, slug, name, description``.

    Fields are cleaned first. A slug in use, or taken by an earlier valid draft of the batch, is
    a ``knowledge_base_conflict``. New bases get the index identity of ``config`` and a stable id
    made from the slug.
    """
    name = strip(F.col("name"))
    about = F.nullif(strip(F.col("description")), F.lit(""))
    clean = normalize_fields(drafts).withColumns({"name": name, "description": about})
    invalid = (
        F.when(F.size("field_violations") > 0, "slug_invalid")
        .when(~F.coalesce(F.length("name").between(1, 200), F.lit(False)), "name_invalid")
        .when(F.length("description") > 2000, "description_invalid")
    )
    judged = clean.withColumn("reject_code", invalid).drop("field_violations")
    valid_seq = F.when(F.col("reject_code").isNull(), F.col("draft_seq"))
    used = existing.select("slug", F.lit(True).alias("_used"))
    per_slug = (
        judged.groupBy("slug")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(valid_seq).alias("_first"))
        .join(used, "slug", "left")
    )
    taken = F.col("_used").isNotNull() | (F.col("draft_seq") != F.col("_first"))
    marked = attach_per_key(judged, per_slug, ["slug"], "_rows", hot_rows).withColumn(
        "reject_code",
        F.coalesce(F.col("reject_code"), F.when(taken, "knowledge_base_conflict")),
    ).drop("_used", "_first")
    created = marked.where(F.col("reject_code").isNull()).select(
        F.sha2("slug", 256).alias("knowledge_base_id"),
        "slug", "name", "description",
        F.lit(config.model_id).alias("embedding_model_id"),
        F.lit(config.revision).alias("embedding_model_revision"),
        F.lit(config.dimension).alias("embedding_dimension"),
        F.lit(config.normalized).alias("embedding_normalized"),
    )
    rejects = marked.where(F.col("reject_code").isNotNull()).select(
        "draft_seq", "slug", "reject_code")
    return created, rejects
