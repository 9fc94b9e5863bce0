"""Run logs: fold event streams to terminal rows, admit new runs, stage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import is_blank, strip
from askgrid.plans.skew import HOT_ROWS, attach_per_key, exact_percentiles

# Terminal error codes.
PROTOCOL_ERROR, CANCELLED_CODE, INTERNAL_ERROR = (
    "pipeline_protocol", "client_cancelled", "internal_error",
)
TERMINAL_KINDS = ("done", "error", "cancel")
DONE_FIELDS = ("outcome", "intent_route", "model_id", "finish_reason", "input_tokens",
               "output_tokens", "trace")
EVENT_SCHEMA = (
    "run_id bigint, conversation_id bigint, seq bigint, kind string, text string, "
    "outcome string, intent_route string, model_id string, finish_reason string, "
    "input_tokens bigint, output_tokens bigint, source_ids array<string>, "
    "trace array<struct<stage:string,duration_ms:double,candidate_count:bigint,"
    "degradation_reason:string,decision:string>>"
)


def stable_code(code: Column) -> Column:
    """Error code as stored: trimmed, 1 to 100 characters, else the internal default."""
    return F.when(F.length(strip(code)).between(1, 100), strip(code)).otherwise(INTERNAL_ERROR)


def completion_is_valid(outcome: Column, answer: Column, route: Column, n_sources: Column,
                        model_id: Column, finish_reason: Column, has_usage: Column) -> Column:
    """Whether the fields of a terminal event fit its outcome."""

    def filled(text: Column) -> Column:
        return text.isNotNull() & ~is_blank(text)

    answered = filled(answer) & filled(model_id) & filled(finish_reason)
    completed = answered & (
        ((route == "knowledge_base") & (n_sources > 0))
        | ((route == "system_direct") & (n_sources == 0))
    )
    asked = answered & (route == "clarification") & (n_sources == 0)
    nothing = (
        (route == "knowledge_base") & answer.isNull() & (n_sources == 0)
        & model_id.isNull() & finish_reason.isNull() & ~has_usage
    )
    return F.coalesce(
        F.when(outcome == "completed", completed)
        .when(outcome == "clarification", asked)
        .when(outcome == "no_context", nothing),
        F.lit(False),
    )


def fold_runs(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per run from its events (see ``EVENT_SCHEMA``), ordered by ``seq``.

    The first terminal event decides; what follows it is ignored. Before it, content after
    guidance, guidance after content and a second guidance are protocol errors, as is a run that
    never ends. Failed and cancelled runs keep no answer, sources or trace, so their content is
    not collected; for the others the list collected is the answer itself.
    """
    seq, kind = F.col("seq"), F.col("kind")
    payload = F.struct(seq, kind, "text", *DONE_FIELDS)
    heads = events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("conversation_id").alias("conversation_id"),
        F.min_by(payload, F.when(kind.isin(*TERMINAL_KINDS), seq)).alias("_end0"),
        F.min(F.when(kind.isin(*TERMINAL_KINDS), seq)).alias("_end_seq"),
        F.min(F.when(kind == "content", seq)).alias("_content"),
        F.min(F.when(kind == "guidance", seq)).alias("_guide"),
    ).withColumn("_end", F.when(F.col("_end_seq").isNotNull(), F.col("_end0"))).drop("_end0")
    live = attach_per_key(
        events.where(kind.isin("content", "guidance", "sources")).select(
            "run_id", "seq", "kind", "text", "source_ids"
        ),
        heads.select("run_id", "_rows", "_end_seq", F.col("_end.kind").alias("_end_kind"),
                     "_content", "_guide"),
        ["run_id"],
        "_rows",
        hot_rows,
    ).where(F.col("_end_seq").isNull() | (seq < F.col("_end_seq")))
    wrong = F.coalesce(
        ((kind == "content") & (seq > F.col("_guide")))
        | ((kind == "guidance") & ((seq > F.col("_guide")) | (F.col("_content") < seq))),
        F.lit(False),
    )
    bodies = live.groupBy("run_id").agg(
        F.bool_or(wrong).alias("_wrong"),
        F.array_sort(
            F.collect_list(
                F.when((kind == "content") & (F.col("_end_kind") == "done"),
                       F.struct("seq", "text"))
            )
        ).alias("_parts"),
        F.min_by(F.when(kind == "guidance", F.col("text")),
                 F.when(kind == "guidance", seq)).alias("_guidance"),
        F.max_by("source_ids", F.when(kind == "sources", seq)).alias("_sources"),
    )
    answer = F.when(
        F.size(F.coalesce("_parts", F.array().cast("array<struct<seq:bigint,text:string>>"))) > 0,
        F.array_join(F.transform("_parts", lambda p: p["text"]), ""),
    ).otherwise(F.col("_guidance"))
    out = heads.join(bodies, "run_id", "left").withColumn("_answer", answer)
    end = F.col("_end")
    n_sources = F.greatest(F.size(F.coalesce("_sources", F.array().cast("array<string>"))), F.lit(0))
    valid = completion_is_valid(
        end["outcome"], F.col("_answer"), end["intent_route"], n_sources, end["model_id"],
        end["finish_reason"], end["input_tokens"].isNotNull() | end["output_tokens"].isNotNull(),
    )
    error = (
        F.when(F.coalesce("_wrong", F.lit(False)) | end.isNull(), PROTOCOL_ERROR)
        .when(end["kind"] == "error", stable_code(F.coalesce(end["text"], F.lit(""))))
        .when(end["kind"] == "cancel", CANCELLED_CODE)
        .when(~valid, INTERNAL_ERROR)
    )
    out = out.withColumn("error_code", error)
    fine = F.col("error_code").isNull()
    status = (
        F.when(fine, end["outcome"])
        .when(F.col("error_code") == CANCELLED_CODE, "cancelled")
        .otherwise("failed")
    )
    return out.select(
        "run_id",
        "conversation_id",
        status.alias("status"),
        F.when(fine, F.col("_answer")).alias("answer"),
        F.when(fine, F.coalesce("_sources", F.array().cast("array<string>"))).alias(
            "source_chunk_ids"),
        *[F.when(fine, end[f]).alias(f) for f in DONE_FIELDS if f != "outcome"],
        "error_code",
    )


def run_messages(runs: DataFrame) -> DataFrame:
    """The assistant message of each completed or clarification run, to append after the user's."""
    return runs.where(F.col("status").isin("completed", "clarification")).select(
        "conversation_id",
        "run_id",
        F.lit("assistant").alias("role"),
        F.col("answer").alias("content"),
        F.col("run_id").alias("seq"),
    )


def admit_runs(runs: DataFrame, begins: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``begins`` with ``admitted`` and ``error_code``: one running run per conversation.

    Nothing is admitted while a run is running; otherwise the first begin of the batch is.
    """
    running = (
        runs.where(F.col("status") == "running").select("conversation_id").distinct()
        .withColumn("_busy", F.lit(True))
    )
    per_key = (
        begins.groupBy("conversation_id")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("begin_seq").alias("_first"))
        .join(running, "conversation_id", "left")
    )
    return (
        attach_per_key(begins, per_key, ["conversation_id"], "_rows", hot_rows)
        .withColumn("admitted", F.col("_busy").isNull() & (F.col("begin_seq") == F.col("_first")))
        .withColumn("error_code", F.when(~F.col("admitted"), "conversation_busy"))
        .drop("_busy", "_first")
    )


def explode_trace(runs: DataFrame) -> DataFrame:
    """One row per (run, stage) of the stored traces."""
    return runs.select("run_id", F.explode("trace").alias("t")).select("run_id", "t.*")


def stage_stats(stages: DataFrame) -> DataFrame:
    """Per stage: counts, degradations, and interpolated p50 and p95 of the duration."""
    counts = stages.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("degradation_reason").alias("degraded"),
        F.count("decision").alias("decided"),
    )
    times = exact_percentiles(stages, ["stage"], "duration_ms", [0.5, 0.95], ["p50_ms", "p95_ms"])
    return counts.join(times, "stage", "left")


def stage_decisions(stages: DataFrame) -> DataFrame:
    """Counts per (stage, decision, degradation reason)."""
    return stages.groupBy("stage", "decision", "degradation_reason").agg(
        F.count(F.lit(1)).alias("n")
    )
