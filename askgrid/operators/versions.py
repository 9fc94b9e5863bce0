"""Versioned corpus maintenance: upserts, version numbers, activation, deletes, status.

Attempts on one source may be a large share of a batch: numbering is range-cut, and per-document
facts are aggregates joined back with hot documents spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import ANY_CONTROL, strip
from askgrid.plans.shared import written
from askgrid.plans.skew import HOT_ROWS, attach_per_key, number_within

DOCUMENT_KEY = ["knowledge_base_id", "source_key"]


def document_id(kb: Column, source_key: Column) -> Column:
    """Stable id of a logical document, so that replays give the same rows."""
    return F.sha2(F.concat_ws("\n", kb.cast("string"), source_key), 256)


def version_id(document: Column, number: Column) -> Column:
    return F.sha2(F.concat_ws("\n", document, number.cast("string")), 256)


def upsert_documents(documents: DataFrame, attempts: DataFrame) -> DataFrame:
    """Logical documents after a batch: new keys added, names taken from the latest attempt.

    The latest attempt names the document even if it failed later on.
    """
    latest = attempts.groupBy(*DOCUMENT_KEY).agg(
        F.max_by("filename", "attempt_seq").alias("_name")
    )
    return (
        documents.join(latest, DOCUMENT_KEY, "full_outer")
        .withColumn("display_name", F.coalesce("_name", "display_name"))
        .withColumn(
            "document_id",
            F.coalesce("document_id",
                       document_id(F.col("knowledge_base_id"), F.col("source_key"))),
        )
        .select("document_id", *DOCUMENT_KEY, "display_name")
    )


def assign_versions(versions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts with ``document_id, version_number, version_id``.

    Numbers follow the highest existing one, failed versions included, in attempt order.
    """
    known = versions.groupBy("document_id").agg(F.max("version_number").alias("_base"))
    keyed = attempts.withColumn(
        "document_id", document_id(F.col("knowledge_base_id"), F.col("source_key"))
    )
    # Attempts with equal order are numbered by their other facts, so that a retry agrees.
    tie = sorted(c.name for c in attempts.schema
                 if c.name not in (*DOCUMENT_KEY, "attempt_seq")
                 and c.dataType.simpleString() in ("string", "boolean", "bigint", "int"))
    return (
        number_within(keyed, ["document_id"], "attempt_seq", "_n", tie, per_key=known)
        .withColumn("version_number", F.coalesce("_base", F.lit(0)) + F.col("_n"))
        .withColumn("version_id", version_id(F.col("document_id"), F.col("version_number")))
        .drop("_base", "_n")
    )


def apply_attempts(versions: DataFrame, attempts: DataFrame, hot_rows: int = HOT_ROWS
                   ) -> DataFrame:
    """Version rows after a batch of numbered attempts (``assign_versions``) with ``ok``.

    The last success of a document becomes active and supersedes every earlier active version; a
    failure is recorded and leaves the active version alone.
    """
    columns = ["document_id", "knowledge_base_id", "version_number", "version_id",
               "content_sha256", "status", "error_code"]
    fresh = attempts.withColumns({
        "status": F.when(F.col("ok"), "succeeded").otherwise("failed"),
        "error_code": F.when(~F.col("ok"), F.col("error_code")),
    }).select(*columns)
    every = versions.select(*columns).unionByName(fresh)
    per_key = every.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max(F.when(F.col("status") == "succeeded", F.col("version_number"))).alias("_last"),
    )
    joined = attach_per_key(every, per_key, ["document_id"], "_rows", hot_rows)
    status = (
        F.when((F.col("status") == "succeeded") & (F.col("version_number") == F.col("_last")),
               "active")
        .when(F.col("status") == "succeeded", "superseded")
        .when((F.col("status") == "active") & F.col("_last").isNotNull(), "superseded")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).drop("_last")


def active_chunks(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks of active versions."""
    active = versions.where(F.col("status") == "active").select("version_id")
    return chunks.join(active, "version_id", "left_semi")


def plan_import(versions: DataFrame, batch: DataFrame, hot_rows: int = HOT_ROWS,
                order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(to_import, skipped)``: a document whose active hash equals the new one is skipped.

    With ``order``, attempts of one document follow each other as in single imports: each is
    compared with the one before it, the first with the stored version. A skipped attempt leaves
    the active hash as it is, so the hash before is the active one. Attempts are numbered exactly
    and meet their predecessor by number, so a hot document is spread.

    ``versions`` and ``batch`` carry ``knowledge_base_id, source_key, content_sha256``. Copies of
    one document may fill much of a batch, so equal keys are counted first and the verdict is
    joined back with hot keys spread.
    """
    if order is not None:
        stored = versions.where(F.col("status") == "active").groupBy(*DOCUMENT_KEY).agg(
            F.max_by("content_sha256", "version_id").alias("_active"))
        numbered = written(number_within(batch, DOCUMENT_KEY, order, "_n", ["content_sha256"],
                                         per_key=stored))
        earlier = numbered.select(*DOCUMENT_KEY, (F.col("_n") + 1).alias("_n"),
                                  F.col("content_sha256").alias("_before"))
        judged = numbered.join(earlier, [*DOCUMENT_KEY, "_n"], "left").withColumn(
            "_same", F.coalesce(
                F.col("content_sha256") == F.when(F.col("_n") == 1, F.col("_active")).otherwise(
                    F.col("_before")), F.lit(False)))
        return (judged.where(~F.col("_same")).select(*batch.columns),
                judged.where(F.col("_same")).select(*batch.columns))
    keys = [*DOCUMENT_KEY, "content_sha256"]
    active = (
        versions.where(F.col("status") == "active").select(*keys).distinct()
        .withColumn("_same", F.lit(True))
    )
    per_key = (
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).join(active, keys, "left")
    )
    marked = attach_per_key(batch, per_key, keys, "_rows", hot_rows).select(
        *batch.columns, "_same")
    return (
        marked.where(F.col("_same").isNull()).drop("_same"),
        marked.where(F.col("_same").isNotNull()).drop("_same"),
    )


def import_report(to_import: DataFrame, skipped: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents seen, imported and skipped, and chunks of the imported ones."""

    def tagged(df: DataFrame, what: str) -> DataFrame:
        return df.select(F.lit(what).alias("_w"))

    rows = (
        tagged(to_import, "imported").unionByName(tagged(skipped, "skipped"))
        .unionByName(tagged(chunks, "chunk"))
    )
    kind = F.col("_w")
    return rows.agg(
        F.count_if(kind != "chunk").alias("document_count"),
        F.count_if(kind == "imported").alias("imported_documents"),
        F.count_if(kind == "skipped").alias("skipped_documents"),
        F.count_if(kind == "chunk").alias("imported_chunks"),
    )


def delete_documents(documents: DataFrame, versions: DataFrame, chunks: DataFrame,
                     keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the documents named by ``(knowledge_base_id, document_id)``, cascading."""
    gone = documents.join(
        keys.select("knowledge_base_id", "document_id").distinct(),
        ["knowledge_base_id", "document_id"],
        "left_semi",
    ).select("document_id")
    gone_versions = versions.join(gone, "document_id", "left_semi").select("version_id")
    return (
        documents.join(gone, "document_id", "left_anti"),
        versions.join(gone, "document_id", "left_anti"),
        chunks.join(gone_versions, "version_id", "left_anti"),
    )


def document_status(documents: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: latest attempt with its chunk count, and the active version if any."""
    latest = versions.groupBy("document_id").agg(
        F.max(F.struct("version_number", "version_id", "status", "content_sha256",
                       "error_code")).alias("_v"),
        F.max_by(
            F.when(F.col("status") == "active", F.col("version_id")),
            F.when(F.col("status") == "active", F.col("version_number")),
        ).alias("active_version_id"),
    )
    counts = chunks.groupBy("version_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return (
        documents.join(latest, "document_id")
        .select("document_id", *DOCUMENT_KEY, "display_name", "_v.*", "active_version_id")
        .join(counts, "version_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    )


def normalize_error_code(code: Column, embedding: Column | None = None) -> Column:
    """Stored failure code, or null where the code is unusable.

    Trimmed, 1 to 100 characters, no control characters; codes of the embedding model get the
    prefix ``embedding_``.
    """
    text = strip(code)
    if embedding is not None:
        text = F.when(embedding, F.concat(F.lit("embedding_"), text)).otherwise(text)
    usable = (F.length(text).between(1, 100)) & ~text.rlike(ANY_CONTROL)
    return F.when(usable, text)
