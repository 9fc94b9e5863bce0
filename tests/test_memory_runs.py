from pyspark.sql import functions as F

from askgrid.operators import memory, runs
from conftest import rows

MESSAGE = "conversation_id long, run_id long, ordinal long, role string, content string"


def talk(n, conversation=1):
    return [(conversation, conversation * 100 + i // 2, i + 1, "user" if i % 2 == 0 else
             "assistant", f"m{i + 1}") for i in range(n)]


def done(spark, n, conversation=1, status="completed"):
    return spark.createDataFrame([(conversation * 100 + i, conversation, status)
                                  for i in range(n)],
                                 "run_id long, conversation_id long, status string")


NO_SUMMARY = ("conversation_id long, summarized_through_ordinal long, "
              "source_message_count long, content string, model_id string")


def test_recent_memory_ignores_failed_runs_and_keeps_order(spark):
    messages = spark.createDataFrame(talk(8), MESSAGE)
    state = done(spark, 3).unionByName(done(spark, 4).where("run_id = 103").withColumn(
        "status", F.lit("failed")))
    out = memory.recent_memory(messages, state, turns=2).first()["messages"]
    assert [m["content"] for m in out] == ["m3", "m4", "m5", "m6"]


def test_summary_trigger_counts_prior_messages_and_is_strict(spark):
    messages = spark.createDataFrame(talk(8), MESSAGE)
    none = spark.createDataFrame([], NO_SUMMARY)
    due, _ = memory.summary_candidates(messages, done(spark, 4), none, trigger=4, retain=1)
    assert due.count() == 0
    prior = spark.createDataFrame([(1, 2, 4, "old", "m")], NO_SUMMARY)
    due, members = memory.summary_candidates(messages, done(spark, 4), prior, trigger=4, retain=1,
                                             hot_rows=2)
    row = due.first()
    assert (row["previous_boundary"], row["summarized_through_ordinal"],
            row["source_message_count"]) == (2, 6, 8)
    assert rows(members, "ordinal") == [(3,), (4,), (5,), (6,)]


def test_append_continues_ordinals_with_a_hot_conversation(spark):
    messages = spark.createDataFrame(talk(3), MESSAGE)
    new = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 7)],
                                "conversation_id long, seq long")
    out = rows(memory.append_messages(messages, new), "conversation_id", "seq",
               "ordinal")
    assert out == sorted([(1, i, i + 4) for i in range(200)] + [(2, 7, 1)], key=repr)


def test_turn_check(spark):
    bad = [(2, 200, 1, "assistant", "x"), (2, 200, 2, "user", "y")]
    df = spark.createDataFrame(talk(4) + bad + talk(3, 3), MESSAGE)
    assert rows(memory.check_turns(df), "conversation_id", "complete") == [
        (1, True), (2, False), (3, False)]


def event(run, seq, kind, text=None, **more):
    base = dict.fromkeys(["outcome", "intent_route", "model_id", "finish_reason", "input_tokens",
                          "output_tokens", "source_ids", "trace"])
    return {"run_id": run, "conversation_id": run, "seq": seq, "kind": kind, "text": text,
            **base, **more}


DONE = dict(outcome="completed", intent_route="system_direct", model_id="m",
            finish_reason="stop", input_tokens=1, output_tokens=2)

EVENTS = [
    event(1, 0, "begin"), event(1, 2, "content", "b"), event(1, 1, "content", "a"),
    event(1, 3, "done", **DONE), event(1, 4, "done", **DONE), event(1, 5, "content", "late"),
    event(2, 0, "guidance", "g"), event(2, 1, "content", "x"), event(2, 2, "done", **DONE),
    event(3, 0, "content", "x"), event(3, 1, "guidance", "g"), event(3, 2, "done", **DONE),
    event(4, 0, "guidance", "a"), event(4, 1, "guidance", "b"), event(4, 2, "done", **DONE),
    event(5, 0, "content", "x"),
    event(6, 0, "content", "x"), event(6, 1, "cancel"),
    event(7, 0, "error", " model_timeout "), event(7, 1, "done", **DONE),
    event(8, 0, "guidance", "which?"),
    event(8, 1, "done", **{**DONE, "outcome": "clarification",
                           "intent_route": "clarification"}),
    event(9, 0, "done", outcome="no_context", intent_route="knowledge_base"),
    event(10, 0, "sources", source_ids=["k"]), event(10, 1, "content", "x"),
    event(10, 2, "done", **DONE),  # a direct answer must not cite
    event(11, 0, "sources", source_ids=["k1"]), event(11, 1, "sources", source_ids=["k2"]),
    event(11, 2, "content", "x"),
    event(11, 3, "done", **{**DONE, "intent_route": "knowledge_base"}),
    event(12, 0, "done", **DONE),
    event(13, 0, "error", " "),
]
EXPECTED = {
    1: ("completed", "ab", None), 2: ("failed", None, "pipeline_protocol"),
    3: ("failed", None, "pipeline_protocol"), 4: ("failed", None, "pipeline_protocol"),
    5: ("failed", None, "pipeline_protocol"), 6: ("cancelled", None, "client_cancelled"),
    7: ("failed", None, "model_timeout"), 8: ("clarification", "which?", None),
    9: ("no_context", None, None), 10: ("failed", None, "internal_error"),
    11: ("completed", "x", None), 12: ("failed", None, "internal_error"),
    13: ("failed", None, "internal_error"),
}


def test_run_fold(spark):
    df = spark.createDataFrame(EVENTS, runs.EVENT_SCHEMA)
    for hot in (1, 10**6):
        out = runs.fold_runs(df, hot_rows=hot).collect()
        assert {r["run_id"]: (r["status"], r["answer"], r["error_code"]) for r in out} == EXPECTED
        assert {r["run_id"]: r["source_chunk_ids"] for r in out}[11] == ["k2"]


def test_admission_of_runs(spark):
    state = spark.createDataFrame([(1, 1, "running"), (2, 2, "completed")],
                                  "run_id long, conversation_id long, status string")
    begins = spark.createDataFrame([(1, 5), (2, 6), (2, 7), (3, 8)],
                                   "conversation_id long, begin_seq long")
    out = runs.admit_runs(state, begins, hot_rows=1)
    assert rows(out, "begin_seq", "admitted") == [(5, False), (6, True), (7, False), (8, True)]


def test_merge_summaries_is_optimistic(spark):
    stored = spark.createDataFrame([(1, 4, 4, "old", "m")], NO_SUMMARY)
    updates = spark.createDataFrame(
        [(1, 1, 2, 6, 6, "stale", "m"), (1, 2, 4, 8, 8, "win", "m"), (1, 3, 4, 10, 10, "lost", "m"),
         (2, 4, None, 2, 2, "first", "m"), (3, 5, 9, 12, 12, "no base", "m")],
        "conversation_id long, update_seq long, expected_boundary long, "
        "summarized_through_ordinal long, source_message_count long, content string, "
        "model_id string")
    merged, verdict = memory.merge_summaries(stored, updates)
    assert rows(merged, "conversation_id", "content") == [(1, "win"), (2, "first")]
    assert rows(verdict.where("applied"), "update_seq") == [(2,), (4,)]
