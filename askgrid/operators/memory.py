"""Conversation logs: ordinals, memory windows, turn checks and summary refreshes.

A conversation may own a large share of all messages. Ordinals use range-cut numbering, windows
keep only the newest rows per partition before the shuffle, and everything else is a per-key
aggregate joined back with hot keys spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrid.plans.shared import written
from askgrid.plans.skew import HOT_ROWS, attach_per_key, number_within

RECENT_TURNS = 6
SUMMARY_TRIGGER_TURNS = 12
SUMMARY_RETAIN_TURNS = 6
# Run outcomes whose messages count as remembered.
REMEMBERED = ("completed", "clarification")


def append_messages(messages: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Give each row of ``new`` the next ordinals of its conversation, in ``order``.

    Rows of equal order are numbered by their other facts, so that a retry agrees.
    """
    base = messages.groupBy("conversation_id").agg(F.max("ordinal").alias("_base"))
    tie = sorted(c.name for c in new.schema if c.name not in ("conversation_id", order)
                 and c.dataType.simpleString() in ("string", "boolean", "bigint", "int"))
    return (
        number_within(new, ["conversation_id"], order, "_n", tie, per_key=base)
        .withColumn("ordinal", F.coalesce("_base", F.lit(0)) + F.col("_n"))
        .drop("_base", "_n")
    )


def eligible_messages(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """Messages of runs that completed or asked for clarification."""
    kept = runs.where(F.col("status").isin(*REMEMBERED)).select("run_id")
    return messages.join(kept, "run_id", "left_semi")


def summary_violations(messages: DataFrame, runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """``conversation_id, n_messages, code`` of conversations whose fresh messages are no whole
    turns: their number is odd, so ``summary_candidates`` leaves them out."""
    stored = summaries.select("conversation_id",
                              F.col("summarized_through_ordinal").alias("_boundary"))
    # Counted per (conversation, ordinal) first: a long conversation is spread over its ordinals.
    counts = eligible_messages(messages, runs).groupBy("conversation_id", "ordinal").agg(
        F.count(F.lit(1)).alias("_c"))
    return (
        counts.join(stored, "conversation_id", "left")
        .where(F.col("ordinal") > F.coalesce("_boundary", F.lit(0)))
        .groupBy("conversation_id").agg(F.sum("_c").alias("n_messages"))
        .where("n_messages % 2 = 1")
        .withColumn("code", F.lit("incomplete_turn"))
    )


def _newest(messages: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest messages per conversation; pruned per partition before the shuffle."""
    latest = Window.partitionBy("conversation_id").orderBy(F.col("ordinal").desc())
    return messages.withColumn("_age", F.row_number().over(latest)).where(F.col("_age") <= n)


def recent_memory(messages: DataFrame, runs: DataFrame, turns: int = RECENT_TURNS) -> DataFrame:
    """``(conversation_id, messages)``: the last ``turns`` turns in ascending order."""
    rows = _newest(eligible_messages(messages, runs), 2 * turns)
    item = F.struct(F.col("ordinal").cast("bigint").alias("ordinal"), "role", "content")
    return rows.groupBy("conversation_id").agg(
        F.array_sort(F.collect_list(item)).alias("messages")
    )


def check_turns(messages: DataFrame) -> DataFrame:
    """``(conversation_id, n_messages, complete)``: even count, user and assistant in turn."""
    numbered = number_within(messages, ["conversation_id"], "ordinal", "_n")
    expected = F.when(F.col("_n") % 2 == 1, "user").otherwise("assistant")
    return numbered.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        ((F.count(F.lit(1)) % 2 == 0) & F.bool_and(F.col("role") == expected)).alias("complete"),
    )


def summary_candidates(
    messages: DataFrame,
    runs: DataFrame,
    summaries: DataFrame,
    trigger: int = SUMMARY_TRIGGER_TURNS,
    retain: int = SUMMARY_RETAIN_TURNS,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Conversations due for a summary, and the messages that go into it (as rows).

    Counts the messages after the stored boundary; due when (already summarised + new) // 2
    exceeds ``trigger`` and whole turns are present. All but the last ``2 * retain`` messages
    are taken, which needs only the newest ``2 * retain + 1`` ordinals per conversation.
    """
    if retain < 1 or trigger <= retain:
        raise ValueError("trigger must exceed retain, and retain must be positive")
    eligible = eligible_messages(messages, runs)
    per_key = (
        eligible.groupBy("conversation_id")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .join(
            summaries.select(
                "conversation_id",
                F.col("summarized_through_ordinal").alias("previous_boundary"),
                F.col("source_message_count").alias("_prior"),
                F.col("content").alias("previous_summary"),
            ),
            "conversation_id",
            "left",
        )
    )
    # Read three times below: written once instead of joining the messages three times.
    fresh = written(
        attach_per_key(eligible, per_key, ["conversation_id"], "_rows", hot_rows).where(
            F.col("ordinal") > F.coalesce("previous_boundary", F.lit(0))
        )
    )
    facts = ["previous_boundary", "_prior", "previous_summary"]
    counted = fresh.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("_new"), *[F.first(f).alias(f) for f in facts]
    )
    cut = (
        _newest(fresh.select("conversation_id", "ordinal"), 2 * retain + 1)
        .where(F.col("_age") == 2 * retain + 1)
        .select("conversation_id", F.col("ordinal").alias("summarized_through_ordinal"))
    )
    prior = F.coalesce("_prior", F.lit(0))
    due = (
        counted.where((F.col("_new") % 2 == 0) & (F.floor((prior + F.col("_new")) / 2) > trigger))
        .join(cut, "conversation_id")
        .withColumn("source_message_count", prior + F.col("_new") - 2 * retain)
        .select("conversation_id", "previous_boundary", "previous_summary",
                "summarized_through_ordinal", "source_message_count")
    )
    ends = due.select("conversation_id", "summarized_through_ordinal").join(
        counted.select("conversation_id", F.col("_new").alias("_rows")), "conversation_id"
    )
    members = (
        attach_per_key(fresh.drop(*facts), ends, ["conversation_id"], "_rows", hot_rows, how="inner")
        .where(F.col("ordinal") <= F.col("summarized_through_ordinal"))
        .drop("summarized_through_ordinal")
    )
    return due, members


def merge_summaries(summaries: DataFrame, updates: DataFrame, hot_rows: int = HOT_ROWS
                    ) -> tuple[DataFrame, DataFrame]:
    """``(new summaries, verdict per update)`` under optimistic concurrency.

    An update applies only if the stored boundary equals the one it was computed from. The
    updates of a batch come from one snapshot, so per conversation the earliest by
    ``update_seq`` that matches wins and all others lose.
    """
    key = ["conversation_id"]
    counts = updates.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    stored = summaries.select(*key, F.col("summarized_through_ordinal").alias("_stored"))
    judged = attach_per_key(
        updates, counts.join(stored, key, "left"), key, "_rows", hot_rows
    )
    fields = ["summarized_through_ordinal", "source_message_count", "content", "model_id"]
    winners = (
        judged.where(F.col("_stored").eqNullSafe(F.col("expected_boundary")))
        .groupBy(*key)
        .agg(F.min(F.struct("update_seq", *fields)).alias("_w"))
    )
    merged = (
        summaries.select(*key, *fields)
        .join(winners, key, "full_outer")
        .select(
            *key,
            *[
                F.when(F.col("_w").isNotNull(), F.col(f"_w.{f}")).otherwise(F.col(f)).alias(f)
                for f in fields
            ],
        )
    )
    won = counts.join(
        winners.select(*key, F.col("_w.update_seq").alias("_won")), key, "left"
    )
    verdict = attach_per_key(
        updates.select(*key, "update_seq"), won, key, "_rows", hot_rows
    ).select(
        *key,
        "update_seq",
        F.coalesce(F.col("update_seq") == F.col("_won"), F.lit(False)).alias("applied"),
    )
    return merged, verdict


def load_memory(requests: DataFrame, messages: DataFrame, runs: DataFrame, summaries: DataFrame,
                turns: int = RECENT_TURNS) -> DataFrame:
    """Requests with their conversation's ``summary`` and recent ``messages`` (null if none)."""
    return requests.join(
        summaries.select("conversation_id", F.col("content").alias("summary")),
        "conversation_id",
        "left",
    ).join(recent_memory(messages, runs, turns), "conversation_id", "left")
