"""Continuous corpus ingest: each micro-batch of files is admitted, chunked, embedded, versioned.

Tables below ``root`` are hash-bucketed by document and kept by ``sources.commits``:

* ``heads``: a delta log: a commit adds one row per document of its batch, with the document's last
  and active version; the newest row of a document counts, and buckets with many deltas are
  rewritten by ``compact``;
* ``attempts`` and ``chunks``: one row per version and per chunk of a version;
* ``rejects``: files refused at admission or parsing.

A batch reads and writes only the buckets of its documents, and its rows in all tables become
visible with one manifest. A version is active exactly if its head says so, so old rows are never
rewritten. The manifest also holds the last batch of every stream, so a repeat is recognised, and a
new or lost checkpoint continues where the tables stand. Two writers on one root cannot take the same
number: the later one works again from the other's state if they share a bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from askgrid.functions.codecs import Codec
from askgrid.operators.admission import identify
from askgrid.operators.chunking import OVERLAP_TOKENS, TARGET_TOKENS, chunk_documents
from askgrid.operators.embedding import embed, validate_vectors
from askgrid.operators.segment import with_blocks
from askgrid.operators.versions import (
    DOCUMENT_KEY, assign_versions, document_id, plan_import,
)
from askgrid.plans.shared import written
from askgrid.sources import commits
from askgrid.sources.commits import Change, Manifest

HEADS = (
    "document_id string, knowledge_base_id string, source_key string, display_name string, "
    "last_version bigint, active_version bigint, active_version_id string, active_sha256 string, "
    "snapshot bigint, since bigint, deleted boolean"
)
TABLES = ("heads", "attempts", "chunks", "rejects")
#: Times a batch is computed again because another writer changed its documents meanwhile.
MOST_TRIES = 20

# Fixed value: columns of Spark's binary file source, which a stream must state.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _heads(spark: SparkSession, root: str, manifest: Manifest, buckets=None) -> DataFrame:
    """The newest row of every document, deleted ones included."""
    rows = commits.read_table(spark, root, manifest, "heads", HEADS, buckets)
    last = F.max_by(F.struct("*"), "snapshot").alias("h")
    return rows.groupBy("document_id").agg(last).select("h.*")


def read_heads(spark: SparkSession, root: str, snapshot: int | None = None) -> DataFrame:
    """One row per logical document, now or after commit ``snapshot``."""
    manifest = (commits.newest(spark, root) if snapshot is None
                else commits.read_manifest(spark, root, snapshot))
    return _heads(spark, root, manifest).where("not deleted").drop("bucket", "deleted")


def _rows(spark: SparkSession, root: str, table: str, manifest: Manifest, buckets=None
          ) -> DataFrame:
    """Rows of ``attempts`` or ``chunks`` with the head of their document; deleted ones are gone.

    A document that was deleted and came again starts anew: its rows of before do not count.
    """
    names = [n for of in manifest.folders(table).values() for n in of]
    if not names:
        raise FileNotFoundError(f"{root}/{table}")
    schema = spark.read.parquet(f"{root}/{table}/commit={names[0]}").drop("bucket").schema
    heads = _heads(spark, root, manifest, buckets).where("not deleted").select(
        "document_id", "active_version_id", "since")
    rows = commits.read_table(spark, root, manifest, table, schema, buckets)
    return rows.join(heads, "document_id").where(F.col("snapshot") >= F.col("since"))


def _active(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("version_id") == F.col("active_version_id"))


def read_active_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of the active version of every document."""
    rows = _rows(spark, root, "chunks", commits.newest(spark, root))
    return _active(rows).drop("active_version_id", "since", "snapshot", "bucket")


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """All versions with their present status; batches that are not committed are unseen."""
    rows = _rows(spark, root, "attempts", commits.newest(spark, root))
    return rows.withColumn(
        "status",
        F.when(~F.col("ok"), "failed")
        .when(F.col("version_id") == F.col("active_version_id"), "active")
        .otherwise("superseded"),
    ).drop("since", "bucket")


def ingest_batch(batch: DataFrame, epoch: int, root: str, dimension: int = 768,
                 load: Callable | None = None, codec: str | Codec = "words",
                 target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS,
                 stream: str = "batches", skip_unchanged: bool = True) -> None:
    """Ingest one batch of ``knowledge_base_id, source_key, filename, media_type, content,
    attempt_seq``; files whose hash equals that of the attempt before them are skipped.

    Without ``skip_unchanged`` every attempt is an upload with a version of its own, as in the
    reference, where only the import of a corpus compares hashes.

    ``stream`` names the source of ``epoch``; epochs of a stream rise, each is ingested once.
    """
    spark = batch.sparkSession
    parsed: DataFrame | None = None
    staging = f"{root}/staging/commit={commits.new_token()}"
    try:
        for _ in range(MOST_TRIES):
            base = commits.newest(spark, root)
            if base.streams.get(stream, -1) >= epoch:
                return
            if parsed is None:
                # Written once: neither a retry nor a lost executor parses again.
                parsed = written(with_blocks(identify(batch)).withColumns({
                    "reject_code": F.coalesce("reject_code", "parse_code"),
                    "document_id": document_id(F.col("knowledge_base_id"), F.col("source_key")),
                }).withColumn("bucket", commits.bucket_of("document_id", base.buckets))
                    .drop("parse_code", "content", "text"), staging)
            change = _prepare(parsed, base, root, dimension, load, codec, target, overlap,
                              skip_unchanged)
            change = Change(change.token, change.added, {}, stream, epoch, change.read)
            done = commits.publish(spark, root, base, change)
            if done is not None:
                compact_heads(spark, root, done)
                return
        raise RuntimeError(f"other writers changed the documents of the batch {MOST_TRIES} times")
    finally:
        if parsed is not None:
            commits.drop_folder(spark, staging)


def _prepare(parsed: DataFrame, base: Manifest, root: str, dimension: int, load, codec,
             target: int, overlap: int, skip_unchanged: bool) -> Change:
    """Write the rows of a batch on top of ``base``; nothing is visible before it is published."""
    spark, token, number = parsed.sparkSession, commits.new_token(), base.number + 1
    buckets = [r["bucket"] for r in parsed.select("bucket").distinct().collect()]
    stamped = {"snapshot": F.lit(number).cast("bigint"),
               "bucket": commits.bucket_of("document_id", base.buckets)}
    commits.append(parsed.where(F.col("reject_code").isNotNull()).drop("blocks"), root, "rejects",
                   token)
    good = parsed.where(F.col("reject_code").isNull()).drop("bucket")
    stored = _heads(spark, root, base, buckets).drop("bucket")
    heads = stored.where("not deleted")
    facts = good.select(*DOCUMENT_KEY, "filename", "attempt_seq", "content_sha256")
    if skip_unchanged:
        active = heads.where(F.col("active_sha256").isNotNull()).select(
            *DOCUMENT_KEY, F.col("active_sha256").alias("content_sha256"),
            F.col("active_version_id").alias("version_id"), F.lit("active").alias("status"))
        facts, _ = plan_import(active, facts, order="attempt_seq")
    numbers = heads.select("document_id", F.col("last_version").alias("version_number"))
    numbered = written(assign_versions(numbers, facts), f"{root}/staging/commit={token}")
    try:
        with_version = good.join(
            numbered.select("document_id", "attempt_seq", "content_sha256", "version_id"),
            ["document_id", "attempt_seq", "content_sha256"]).dropDuplicates(["version_id"])
        chunks = embed(chunk_documents(with_version, "version_id", target, overlap, codec),
                       "content", dimension, True, load)
        checked = validate_vectors(chunks, dimension).join(
            numbered.select("version_id", "document_id"), "version_id").withColumns(stamped)
        commits.append(checked, root, "chunks", token)
        bad = (
            commits.read_table(spark, root, _only(token, "chunks", spark, root), "chunks",
                               checked.drop("bucket").schema)
            .where(F.col("violation").isNotNull()).select("version_id").distinct()
            .withColumn("_bad", F.lit(True))
        )
        attempts = numbered.join(bad, "version_id", "left").withColumns({
            "ok": F.col("_bad").isNull(),
            "error_code": F.when(F.col("_bad").isNotNull(), "embedding_protocol"),
            **stamped,
        }).drop("_bad")
        commits.append(attempts, root, "attempts", token)
        done = commits.read_table(spark, root, _only(token, "attempts", spark, root), "attempts",
                                  attempts.drop("bucket").schema)
        changed = _next_heads(
            heads.join(done.select("document_id").distinct(), "document_id", "left_semi"), done
        ).withColumns({**stamped, "since": F.coalesce("since", F.lit(number).cast("bigint")),
                       "deleted": F.lit(False)})
        commits.append(changed, root, "heads", token)
    finally:
        commits.drop_folder(spark, f"{root}/staging/commit={token}")
    added = {t: commits.buckets_in(spark, root, t, token) for t in TABLES}
    return Change(token, added, read=buckets)


def _only(token: str, table: str, spark: SparkSession, root: str) -> Manifest:
    """A manifest of one folder, to read back what was just written."""
    return Manifest(tables={table: {str(b): [token]
                                    for b in commits.buckets_in(spark, root, table, token)}})


def delete_documents(spark: SparkSession, root: str, keys: DataFrame) -> None:
    """Drop the documents ``knowledge_base_id, source_key`` with their versions and chunks.

    One commit of head rows: readers lose all rows of a document at once; ``compact`` removes them.
    """
    for _ in range(MOST_TRIES):
        base = commits.newest(spark, root)
        token = commits.new_token()
        marked = keys.select(*DOCUMENT_KEY).distinct().withColumn(
            "document_id", document_id(*[F.col(c) for c in DOCUMENT_KEY]))
        buckets = [r[0] for r in marked.select(
            commits.bucket_of("document_id", base.buckets)).distinct().collect()]
        gone = _heads(spark, root, base, buckets).where("not deleted").join(
            marked.select("document_id"), "document_id", "left_semi").withColumns(
                {"deleted": F.lit(True), "snapshot": F.lit(base.number + 1).cast("bigint")})
        commits.append(gone, root, "heads", token)
        change = Change(token, {"heads": commits.buckets_in(spark, root, "heads", token)},
                        read=buckets)
        if commits.publish(spark, root, base, change) is not None:
            return
    raise RuntimeError(f"other writers changed the documents {MOST_TRIES} times")


def compact_heads(spark: SparkSession, root: str, base: Manifest,
                  at: int = commits.COMPACT_AT) -> bool:
    """Rewrite the buckets of the delta log with at least ``at`` deltas, one row per document.

    Gives way to writers: if one of these buckets changes meanwhile, nothing is done.
    """
    buckets = commits.crowded(base, "heads", at)
    if not buckets:
        return False
    token = commits.new_token()
    commits.append(_heads(spark, root, base, buckets), root, "heads", token)
    change = Change(token, {"heads": commits.buckets_in(spark, root, "heads", token)},
                    {"heads": buckets})
    return commits.publish(spark, root, base, change) is not None


def compact(spark: SparkSession, root: str, at: int = commits.COMPACT_AT) -> bool:
    """Rewrite crowded buckets of all tables; chunks of superseded versions are left out.

    Versions keep their rows, as numbering needs them. What is replaced stays until
    ``commits.vacuum``.
    """
    base = commits.newest(spark, root)
    compact_heads(spark, root, base, at)
    base = commits.newest(spark, root)
    token, added, replaced = commits.new_token(), {}, {}
    for table in ("attempts", "chunks"):
        buckets = commits.crowded(base, table, at)
        if not buckets:
            continue
        rows = _rows(spark, root, table, base, buckets)
        rows = (_active(rows) if table == "chunks" else rows).drop("active_version_id", "since")
        commits.append(rows, root, table, token)
        added[table] = commits.buckets_in(spark, root, table, token)
        replaced[table] = buckets
    if not replaced:
        return False
    return commits.publish(spark, root, base, Change(token, added, replaced)) is not None


def _next_heads(heads: DataFrame, attempts: DataFrame) -> DataFrame:
    """Heads after a batch; one aggregate per document, so hot documents combine early."""
    good = F.when(F.col("ok"), F.col("version_number"))
    batch = attempts.groupBy("document_id").agg(
        F.first("knowledge_base_id").alias("_kb"),
        F.first("source_key").alias("_key"),
        F.max_by("filename", "version_number").alias("_name"),
        F.max("version_number").alias("_last"),
        F.max(good).alias("_active"),
        F.max_by("version_id", good).alias("_active_id"),
        F.max_by("content_sha256", good).alias("_active_sha"),
    )
    moved = F.col("_active").isNotNull()
    return heads.join(batch, "document_id", "full_outer").select(
        "document_id",
        F.coalesce("knowledge_base_id", "_kb").alias("knowledge_base_id"),
        F.coalesce("source_key", "_key").alias("source_key"),
        F.coalesce("_name", "display_name").alias("display_name"),
        F.coalesce("_last", "last_version").alias("last_version"),
        F.when(moved, F.col("_active")).otherwise(F.col("active_version")).alias(
            "active_version"),
        F.when(moved, F.col("_active_id")).otherwise(F.col("active_version_id")).alias(
            "active_version_id"),
        F.when(moved, F.col("_active_sha")).otherwise(F.col("active_sha256")).alias(
            "active_sha256"),
        "since",
    )


def file_stream(spark: SparkSession, folder: str, glob: str = "*.*") -> DataFrame:
    """Stream of files below ``folder``: the first sub-folder is the knowledge base."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
    )
    base = folder.rstrip("/").split("/")[-1]
    parts = F.split(F.element_at(F.split("path", f"/{base}/"), -1), "/")
    return files.select(
        F.when(F.size(parts) > 1, parts[0]).otherwise("default").alias("knowledge_base_id"),
        F.array_join(parts, "/").alias("source_key"),
        F.element_at(parts, -1).alias("filename"),
        F.lit(None).cast("string").alias("media_type"),
        "content",
        F.unix_micros("modificationTime").alias("attempt_seq"),
    )


def ingest_stream(source: DataFrame, root: str, checkpoint: str, available_now: bool = False,
                  **options) -> StreamingQuery:
    """Start the continuous ingest; ``available_now`` stops after the present input."""
    def one(batch: DataFrame, epoch: int) -> None:
        # The id of this stream; a checkpoint made anew has another one.
        held = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        ingest_batch(batch, epoch, root, stream=json.loads(held)["id"], **options)

    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
