"""Queries over conversation logs and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from askgrid.operators import memory, runs as run_ops
from askgrid.plans.shared import written
from askgrid.plans.skew import number_within
from askgrid.workload.data import Registry, table

R = Registry()


def messages(spark, d):
    rows = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return number_within(rows, ["conv_id"], "turn", "ordinal").select(
        F.col("conv_id").alias("conversation_id"),
        F.expr("conv_id * 100 + turn div 2").alias("run_id"),
        "ordinal", "role", F.col("text").alias("content"), "turn",
    )


def runs(spark, d):
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("conversation_id"),
        F.expr("conv_id * 100 + turn div 2").alias("run_id")).distinct()
    i = F.col("run_id") % 7
    return rows.withColumn(
        "status",
        F.when(i == 0, "failed").when(i == 1, "no_context").when(i == 2, "clarification")
        .otherwise("completed"))


MESSAGES_SQL = """messages as (
  select conv_id as conversation_id, conv_id * 100 + turn // 2 as run_id, role, text as content,
    turn, row_number() over (partition by conv_id order by turn) as ordinal
  from conversations where role in ('user', 'assistant'))"""
RUNS_SQL = """runs as (
  select distinct conv_id as conversation_id, conv_id * 100 + turn // 2 as run_id,
    case (conv_id * 100 + turn // 2) % 7 when 0 then 'failed' when 1 then 'no_context'
      when 2 then 'clarification' else 'completed' end as status
  from conversations)"""
ELIGIBLE_SQL = "with " + MESSAGES_SQL + ", " + RUNS_SQL + """,
eligible as (select m.* from messages m join runs r using (run_id)
  where r.status in ('completed', 'clarification'))"""


@R.add("f1_append_messages", "with " + MESSAGES_SQL + """,
old as (select * from messages where turn < 3),
fresh as (select conv_id, turn, role, text from conversations
  where role = 'system' or turn >= 3)
select f.conv_id as conversation_id, f.turn as seq, f.role,
  coalesce(o.last, 0) + row_number() over (partition by f.conv_id order by f.turn) as ordinal
from fresh f left join (select conversation_id, max(ordinal) as last from old group by 1) o
  on o.conversation_id = f.conv_id""")
def _f1(spark, d):
    old = messages(spark, d).where("turn < 3")
    new = table(spark, d, "conversations").where("role = 'system' or turn >= 3").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", "text")
    return memory.append_messages(old, new).select("conversation_id", "seq", "role", "ordinal")


@R.add("f2_eligible_messages", ELIGIBLE_SQL + """
select conversation_id, run_id, ordinal, role from eligible""")
def _f2(spark, d):
    return memory.eligible_messages(messages(spark, d), runs(spark, d)).select(
        "conversation_id", "run_id", "ordinal", "role")


RECENT_SQL = ELIGIBLE_SQL + """,
recent as (select * from (select *, row_number() over (partition by conversation_id
    order by ordinal desc) as age from eligible) where age <= 4),
recent_text as (select conversation_id, string_agg(ordinal || role || content, '|'
    order by ordinal) as t, count(*) as n from recent group by 1)"""


def _packed(column):
    return F.array_join(F.transform(column, lambda m: F.concat(
        m["ordinal"].cast("string"), m["role"], m["content"])), "|")


@R.add("f3_recent_memory", RECENT_SQL + """
select conversation_id, n, sha256(t) as memory_sha256 from recent_text""")
def _f3(spark, d):
    out = memory.recent_memory(messages(spark, d), runs(spark, d), turns=2)
    return out.select("conversation_id", F.size("messages").alias("n"),
                      F.sha2(_packed(F.col("messages")), 256).alias("memory_sha256"))


@R.add("f4_check_turns", "with " + MESSAGES_SQL + """
select conversation_id, count(*) as n_messages, count(*) % 2 = 0 and bool_and(role =
    case when n % 2 = 1 then 'user' else 'assistant' end) as complete
from (select *, row_number() over (partition by conversation_id order by ordinal) as n
  from messages) group by 1""")
def _f4(spark, d):
    return memory.check_turns(messages(spark, d))


def summaries(spark, d):
    return table(spark, d, "conversations").where("conv_id % 3 = 0").select(
        F.col("conv_id").alias("conversation_id")).distinct().select(
        "conversation_id",
        F.when(F.col("conversation_id") % 2 == 0, 2).otherwise(1).cast("bigint").alias(
            "summarized_through_ordinal"),
        F.lit(2).cast("bigint").alias("source_message_count"),
        F.concat(F.lit("so far "), F.col("conversation_id").cast("string")).alias("content"),
        F.lit("m0").alias("model_id"),
    )


SUMMARIES_SQL = """summaries as (
  select distinct conv_id as conversation_id, case when conv_id % 2 = 0 then 2 else 1 end
      as summarized_through_ordinal, 2 as source_message_count,
    'so far ' || conv_id as content, 'm0' as model_id
  from conversations where conv_id % 3 = 0)"""
DUE_SQL = ELIGIBLE_SQL + ", " + SUMMARIES_SQL + """,
fresh as (
  select e.*, s.summarized_through_ordinal as previous_boundary, s.content as previous_summary,
    coalesce(s.source_message_count, 0) as prior,
    count(*) over (partition by e.conversation_id) as n,
    row_number() over (partition by e.conversation_id order by e.ordinal desc) as age
  from eligible e left join summaries s using (conversation_id)
  where e.ordinal > coalesce(s.summarized_through_ordinal, 0)),
chosen as (select * from fresh where n % 2 = 0 and (prior + n) // 2 > 2 and age > 2)"""


@R.add("f5_summary_candidates", DUE_SQL + """
select conversation_id, max(previous_boundary) as previous_boundary,
  max(previous_summary) as previous_summary, max(ordinal) as summarized_through_ordinal,
  max(prior) + count(*) as source_message_count from chosen group by 1""")
def _f5(spark, d):
    due, _ = memory.summary_candidates(written(messages(spark, d)), runs(spark, d), summaries(spark, d),
                                       trigger=2, retain=1)
    return due


@R.add("f5_summary_messages", DUE_SQL + "select conversation_id, ordinal, role from chosen")
def _f5m(spark, d):
    _, members = memory.summary_candidates(written(messages(spark, d)), runs(spark, d),
                                           summaries(spark, d), trigger=2, retain=1)
    return members.select("conversation_id", "ordinal", "role")


@R.add("f5_summary_violations", DUE_SQL + """
select conversation_id, count(*) as n_messages, 'incomplete_turn' as code
from fresh group by 1 having count(*) % 2 = 1""")
def _f5v(spark, d):
    return memory.summary_violations(messages(spark, d), runs(spark, d), summaries(spark, d))


def updates(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, d, "conversations").select(
        c.alias("conversation_id"), t.alias("update_seq"),
        F.when(c % 3 == 0, t % 3).when(t % 2 == 0, F.lit(None)).otherwise(t).cast("bigint")
        .alias("expected_boundary"),
        (t + 4).alias("summarized_through_ordinal"),
        (t * 2 + 2).alias("source_message_count"),
        F.concat(F.lit("u"), t.cast("string")).alias("content"), F.lit("m1").alias("model_id"),
    )


UPDATES_SQL = "with " + SUMMARIES_SQL + """,
updates as (
  select conv_id as conversation_id, turn as update_seq,
    case when conv_id % 3 = 0 then turn % 3 when turn % 2 = 0 then null else turn end
      as expected_boundary,
    turn + 4 as summarized_through_ordinal, turn * 2 + 2 as source_message_count,
    'u' || turn as content, 'm1' as model_id from conversations),
matching as (
  select u.*, row_number() over (partition by conversation_id order by update_seq) as n
  from updates u left join summaries s using (conversation_id)
  where u.expected_boundary is not distinct from s.summarized_through_ordinal),
winners as (select * from matching where n = 1)"""


@R.add("f6_merge_summaries", UPDATES_SQL + """
select coalesce(s.conversation_id, w.conversation_id) as conversation_id,
  coalesce(w.summarized_through_ordinal, s.summarized_through_ordinal)
    as summarized_through_ordinal,
  coalesce(w.source_message_count, s.source_message_count) as source_message_count,
  coalesce(w.content, s.content) as content, coalesce(w.model_id, s.model_id) as model_id
from summaries s full join winners w using (conversation_id)""")
def _f6(spark, d):
    return memory.merge_summaries(summaries(spark, d), updates(spark, d))[0]


@R.add("f6_merge_verdicts", UPDATES_SQL + """
select u.conversation_id, u.update_seq, w.update_seq is not null as applied
from updates u left join winners w
  on w.conversation_id = u.conversation_id and w.update_seq = u.update_seq""")
def _f6v(spark, d):
    return memory.merge_summaries(summaries(spark, d), updates(spark, d))[1]


@R.add("f7_load_memory", RECENT_SQL + ", " + SUMMARIES_SQL + """
select x.item_id as request_id, x.item_id as conversation_id, s.content as summary, r.n,
  sha256(r.t) as memory_sha256
from benchmark x left join summaries s on s.conversation_id = x.item_id
left join recent_text r on r.conversation_id = x.item_id""")
def _f7(spark, d):
    requests = table(spark, d, "benchmark").select(
        F.col("item_id").alias("request_id"), F.col("item_id").alias("conversation_id"))
    out = memory.load_memory(requests, messages(spark, d), runs(spark, d), summaries(spark, d),
                             turns=2)
    return out.select(
        "request_id", "conversation_id", "summary",
        F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n"),
        F.sha2(_packed(F.col("messages")), 256).alias("memory_sha256"))


# --- run logs -------------------------------------------------------------------------------

TRACE_TYPE = ("array<struct<stage:string,duration_ms:double,candidate_count:bigint,"
              "degradation_reason:string,decision:string>>")


def run_events(spark, d):
    """Conversation rows as stream events of one run per conversation, plus terminal events."""
    rows = table(spark, d, "conversations")
    c, t = F.col("conv_id"), F.col("turn")
    none = F.lit(None).cast("string")
    no_count = F.lit(None).cast("bigint")
    body = rows.select(
        c.alias("run_id"), (c % 40).alias("conversation_id"), t.alias("seq"),
        F.when(t == 0, "begin").when(F.col("role") == "assistant", "content")
        .when(F.col("role") == "system", "guidance").otherwise("sources").alias("kind"),
        F.col("text"),
        none.alias("outcome"), none.alias("intent_route"), none.alias("model_id"),
        none.alias("finish_reason"), no_count.alias("input_tokens"),
        no_count.alias("output_tokens"),
        F.array((c * 10 + t).cast("string")).alias("source_ids"),
        F.lit(None).cast(TRACE_TYPE).alias("trace"),
    )
    i = c % 5
    def stage(name, ms, count, degraded, decided):
        return F.struct(F.lit(name).alias("stage"), ms.cast("double").alias("duration_ms"),
                        count.alias("candidate_count"), degraded.alias("degradation_reason"),
                        decided.alias("decision"))

    trace = F.array(
        stage("retrieving", c * 1.5, (c % 20).cast("bigint"),
              F.when(c % 4 == 0, "timeout"), none),
        stage("intent", c + 0.25, no_count, none,
              F.when(c % 2 == 0, "high_confidence").otherwise("ambiguous")),
    ).cast(TRACE_TYPE)
    last = F.greatest(F.max("turn") + 1, F.lit(3))
    ends = rows.groupBy("conv_id").agg(last.alias("turn")).where("conv_id % 5 <> 4").withColumn(
        "seq", F.explode(F.when(c % 3 == 0, F.array(t, t + 1)).otherwise(F.array(t))))
    terminal = ends.select(
        c.alias("run_id"), (c % 40).alias("conversation_id"), "seq",
        F.when(i == 3, F.when(c % 2 == 0, "cancel").otherwise("error")).otherwise("done").alias(
            "kind"),
        F.when(i == 3, F.when(c % 4 == 1, F.lit(" provider_timeout ")).otherwise("")).alias("text"),
        F.when(i == 2, "clarification").when(i < 2, "completed").alias("outcome"),
        F.when(i == 0, "knowledge_base").when(i == 1, "system_direct").when(i == 2,
               "clarification").alias("intent_route"),
        F.when(i < 3, "m1").alias("model_id"), F.when(i < 3, "stop").alias("finish_reason"),
        F.when(i < 3, c * 3).alias("input_tokens"), F.when(i < 3, c).alias("output_tokens"),
        F.lit(None).cast("array<string>").alias("source_ids"),
        F.when(i < 3, trace).alias("trace"),
    )
    return body.unionByName(terminal)


FOLD_SQL = """with body as (
  select conv_id, turn as seq, case when turn = 0 then 'begin' when role = 'assistant'
      then 'content' when role = 'system' then 'guidance' else 'sources' end as kind, text,
    (conv_id * 10 + turn)::varchar as source from conversations),
ends as (
  select conv_id, greatest(max(turn) + 1, 3) as end_seq, conv_id % 5 as i from conversations
  group by 1),
live as (
  select b.*, e.i, e.end_seq,
    min(case when kind = 'content' then seq end) over (partition by b.conv_id) as c1,
    min(case when kind = 'guidance' then seq end) over (partition by b.conv_id) as g1
  from body b join ends e using (conv_id) where e.i = 4 or b.seq < e.end_seq),
bodies as (
  select conv_id, max(i) as i,
    coalesce(bool_or((kind = 'content' and seq > g1)
      or (kind = 'guidance' and (seq > g1 or c1 < seq))), false) as wrong,
    string_agg(case when kind = 'content' then text end, '' order by seq) as content,
    min_by(text, seq) filter (kind = 'guidance') as guidance,
    max_by(source, seq) filter (kind = 'sources') as source
  from live group by 1),
judged as (
  select *, coalesce(content, guidance) as answer, case
    when wrong or i = 4 then 'pipeline_protocol'
    when i = 3 and conv_id % 2 = 0 then 'client_cancelled'
    when i = 3 and conv_id % 4 = 1 then 'provider_timeout'
    when i = 3 then 'internal_error'
    when coalesce(content, guidance) is null or trim(coalesce(content, guidance)) = ''
      then 'internal_error'
    when i = 0 and source is null then 'internal_error'
    when i in (1, 2) and source is not null then 'internal_error' end as error_code
  from bodies),
folded as (
  select conv_id as run_id, conv_id % 40 as conversation_id,
    case when error_code = 'client_cancelled' then 'cancelled' when error_code is not null
      then 'failed' when i = 2 then 'clarification' else 'completed' end as status,
    case when error_code is null then answer end as answer,
    case when error_code is null then source end as sources,
    case when error_code is null then case i when 0 then 'knowledge_base' when 1 then
      'system_direct' else 'clarification' end end as intent_route,
    case when error_code is null then conv_id * 3 end as input_tokens, error_code
  from judged)"""


@R.add("f8_fold_runs", FOLD_SQL + """
select run_id, conversation_id, status, sha256(answer) as answer_sha256,
  coalesce(sources, '') as sources, intent_route, input_tokens, error_code from folded""")
def _f8(spark, d):
    return run_ops.fold_runs(run_events(spark, d)).select(
        "run_id", "conversation_id", "status", F.sha2("answer", 256).alias("answer_sha256"),
        F.coalesce(F.array_join("source_chunk_ids", ","), F.lit("")).alias("sources"),
        "intent_route", "input_tokens", "error_code")


@R.add("f9_run_messages", FOLD_SQL + ", " + MESSAGES_SQL + """,
last as (select conversation_id, max(ordinal) as m from messages group by 1)
select f.conversation_id, f.run_id, 'assistant' as role, sha256(f.answer) as answer_sha256,
  coalesce(l.m, 0) + row_number() over (partition by f.conversation_id order by f.run_id)
    as ordinal
from folded f left join last l using (conversation_id)
where f.status in ('completed', 'clarification')""")
def _f9(spark, d):
    new = written(run_ops.run_messages(run_ops.fold_runs(run_events(spark, d))))
    return memory.append_messages(messages(spark, d), new).select(
        "conversation_id", "run_id", "role", F.sha2("content", 256).alias("answer_sha256"),
        "ordinal")


@R.add("f10_admit_runs", "with " + RUNS_SQL + """,
live as (select distinct conversation_id from runs where run_id % 11 = 0),
begins as (select event_id as begin_seq, user_id as conversation_id from events)
select b.conversation_id, b.begin_seq, l.conversation_id is null and n = 1 as admitted,
  case when not (l.conversation_id is null and n = 1) then 'conversation_busy' end as error_code
from (select *, row_number() over (partition by conversation_id order by begin_seq) as n
  from begins) b left join live l using (conversation_id)""")
def _f10(spark, d):
    live = runs(spark, d).withColumn(
        "status", F.when(F.col("run_id") % 11 == 0, "running").otherwise(F.col("status")))
    begins = table(spark, d, "events").select(
        F.col("event_id").alias("begin_seq"), F.col("user_id").alias("conversation_id"))
    return run_ops.admit_runs(live, begins)


def stages(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        e.alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"),
        F.when(e % 17 == 0, "timeout").alias("degradation_reason"),
        F.when(e % 3 == 0, "high_confidence").when(e % 3 == 1, "ambiguous").alias("decision"),
        "ts",
    )


STAGES_SQL = """with stages as (
  select event_id as run_id, event_type as stage, value as duration_ms,
    case when event_id % 17 = 0 then 'timeout' end as degradation_reason,
    case event_id % 3 when 0 then 'high_confidence' when 1 then 'ambiguous' end as decision
  from events)"""


@R.add("f11_stage_stats", STAGES_SQL + """
select stage, count(*) as n, count(degradation_reason) as degraded, count(decision) as decided,
  round(quantile_cont(duration_ms, 0.5), 6) as p50_ms,
  round(quantile_cont(duration_ms, 0.95), 6) as p95_ms from stages group by 1""")
def _f11(spark, d):
    out = run_ops.stage_stats(stages(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms")})


@R.add("f11_stage_decisions", STAGES_SQL + """
select stage, decision, degradation_reason, count(*) as n from stages group by 1, 2, 3""")
def _f11d(spark, d):
    return run_ops.stage_decisions(stages(spark, d))


@R.add("f11_explode_trace", FOLD_SQL + """
select run_id, t.stage, t.duration_ms, t.candidate_count, t.degradation_reason, t.decision
from (select run_id, unnest([
    {'stage': 'retrieving', 'duration_ms': (run_id * 1.5)::double, 'candidate_count': run_id % 20,
     'degradation_reason': case when run_id % 4 = 0 then 'timeout' end, 'decision': null},
    {'stage': 'intent', 'duration_ms': (run_id + 0.25)::double, 'candidate_count': null,
     'degradation_reason': null, 'decision': case when run_id % 2 = 0 then 'high_confidence'
       else 'ambiguous' end}]) as t
  from folded where error_code is null)""")
def _f11t(spark, d):
    return run_ops.explode_trace(run_ops.fold_runs(run_events(spark, d)))
