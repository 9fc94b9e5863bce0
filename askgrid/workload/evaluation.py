"""Queries over retrieval and intent evaluation, gates and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from askgrid.operators import gates, intent_eval as ie, rerank, retrieval_eval as re_
from askgrid.operators import understanding as u
from askgrid.workload import data
from askgrid.workload.data import Registry, table
from askgrid.workload.retrieval import RERANK_SQL, _rerank_inputs, _selected
from askgrid.workload.understanding import SCORES_SQL, decision_sql, intent_scores

R = Registry()


# --- labels ---------------------------------------------------------------------------------

def samples(spark, d):
    """Evaluation samples from the conversation log, with label mistakes of every kind."""
    c, t = F.col("conv_id"), F.col("turn")

    def doc(x):
        return x.cast("string")

    return table(spark, d, "conversations").select(
        (c * 100 + t).alias("query_id"),
        (F.col("role") != "system").alias("requires_rag"),
        (t % 2 == 0).alias("requires_tool"),
        F.when(F.col("role") == "system", F.array().cast("array<string>"))
        .when(c % 11 == 0, F.array(doc(c), doc(c)))
        .when(c % 13 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(doc(c), doc(c * 10 + t))).alias("expected_doc_ids"),
        F.when(c % 7 == 0, F.array(doc(c), doc(c + 1), doc(c + 1)))
        .otherwise(F.array(doc(c + 2000))).alias("expected_doc_ids_nice"),
        F.when(c % 5 == 0, F.array().cast("array<string>"))
        .when(c % 5 == 1, F.array(F.lit("recall"), F.lit("tool_routing")))
        .otherwise(F.array(F.lit("recall"))).alias("eval_metrics"),
    )


SAMPLES_SQL = """samples as (
  select conv_id * 100 + turn as query_id, role <> 'system' as requires_rag,
    turn % 2 = 0 as requires_tool, conv_id as c, turn as t,
    case when role = 'system' then []::varchar[]
      when conv_id % 11 = 0 then [conv_id::varchar, conv_id::varchar]
      when conv_id % 13 = 0 then []::varchar[]
      else [conv_id::varchar, (conv_id * 10 + turn)::varchar] end as req,
    case when conv_id % 7 = 0 then [conv_id::varchar, (conv_id + 1)::varchar,
      (conv_id + 1)::varchar] else [(conv_id + 2000)::varchar] end as nice,
    case conv_id % 5 when 0 then []::varchar[] when 1 then ['recall', 'tool_routing']
      else ['recall'] end as metrics
  from conversations)"""


@R.add("g1_check_labels", "with " + SAMPLES_SQL + """
select query_id, 'required_repeated' as code from samples
  where len(list_distinct(req)) <> len(req)
union all select query_id, 'nice_repeated' from samples where len(list_distinct(nice)) <> len(nice)
union all select query_id, 'required_and_nice_overlap' from samples
  where len(list_intersect(req, nice)) > 0
union all select query_id, 'requires_rag_mismatch' from samples
  where requires_rag <> (len(req) > 0)
union all select query_id, 'metrics_empty' from samples where len(metrics) = 0
union all select query_id, 'tool_metric_missing' from samples
  where requires_tool and not list_contains(metrics, 'tool_routing')""")
def _g1(spark, d):
    return re_.check_labels(samples(spark, d))


@R.add("g2_check_dataset", "with " + SAMPLES_SQL + """,
checks as (
  select 'samples' as "check", count(*) as actual, 500 as expected from samples
  union all select 'rag', count(*) filter (requires_rag), 400 from samples
  union all select 'no_rag', count(*) filter (not requires_rag), 24 from samples
  union all select 'repeated_ids', 0, 0
  union all select 'subset_outside', count(distinct doc_id), 0 from labels
    where doc_id not in (select query_id from samples)
  union all select 'subset_repeated', 0, 0)
select "check", actual::bigint as actual, expected::bigint as expected, actual = expected as passed
from checks""")
def _g2(spark, d):
    quick = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"))
    return re_.check_dataset(samples(spark, d), {"samples": 500, "rag": 400, "no_rag": 24}, quick)


@R.add("g3_missing_gold", "with " + SAMPLES_SQL + """
select document_id, count(*) as n from (
  select unnest(list_concat(req, nice)) as document_id from samples)
where document_id not in (select doc_id::varchar from documents) group by 1""")
def _g3(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"))
    return re_.missing_gold(samples(spark, d), docs)


# --- rankings -------------------------------------------------------------------------------

def gold(spark, d):
    r = F.col("item_id")
    return table(spark, d, "benchmark").select(
        r.alias("query_id"),
        F.array_distinct(F.array(F.expr("item_id div 2"), F.expr("(item_id + 3) div 2"),
                                 F.expr("(item_id * 5) div 4"))).alias("required_document_ids"),
    )


def _ranks_of(chunks):
    return re_.rank_documents(chunks.withColumnRenamed("request_id", "query_id"))


def cases(spark, d):
    selected, results, status = _rerank_inputs(spark, d)
    on = rerank.apply_rerank(selected, results, status, top_k=10)
    built = re_.build_cases(gold(spark, d), _ranks_of(selected), _ranks_of(on))
    # Every fifth rerank call failed, so its case has no ON ranking.
    return built.withColumn("on_document_ids", F.when(F.col("query_id") % 5 != 4,
                                                      F.col("on_document_ids")))


CASES_SQL = RERANK_SQL + """,
on_chunks as (
  select request_id, document_id, case when degradation_reason is null
    then least(10, size) - f.rank + 1 else f.rank end as rank
  from final f where f.rank <= least(10, size)),
off_docs as (
  select request_id, document_id, row_number() over (partition by request_id order by first)
    as doc_rank from (select request_id, document_id, min(rank) as first from selected
      where rank <= 10 group by 1, 2)),
on_docs as (
  select request_id, document_id, row_number() over (partition by request_id order by first)
    as doc_rank from (select request_id, document_id, min(rank) as first from on_chunks
      group by 1, 2)),
gold as (
  select item_id as query_id, list_distinct([item_id // 2, (item_id + 3) // 2,
    (item_id * 5) // 4]) as req from benchmark),
cases as (
  select g.query_id, g.req, o.docs as off_docs,
    case when g.query_id % 5 <> 4 then n.docs end as on_docs
  from gold g
  left join (select request_id, list(document_id order by doc_rank) as docs from off_docs
    group by 1) o on o.request_id = g.query_id
  left join (select request_id, list(document_id order by doc_rank) as docs from on_docs
    group by 1) n on n.request_id = g.query_id),
judged as (
  select *, list_min(list_filter(list_transform(req, lambda x: list_position(off_docs, x)),
      lambda p: p > 0)) as off_rank,
    list_min(list_filter(list_transform(req, lambda x: list_position(on_docs, x)),
      lambda p: p > 0)) as on_rank from cases)"""


@R.add("g4_rank_documents", CASES_SQL + """
select request_id as query_id, document_id, doc_rank from off_docs""")
def _g4(spark, d):
    return _ranks_of(_selected(spark, d))


@R.add("g5_judge_cases", CASES_SQL + """
select query_id, off_rank as first_relevant_rank,
  array_to_string(list_sort(list_filter(req, lambda x: not list_contains(off_docs, x))), ',')
    as missing from judged""")
def _g5(spark, d):
    out = re_.judge_cases(cases(spark, d), "off_document_ids")
    return out.select("query_id", "first_relevant_rank", F.array_join(
        F.array_sort("missing_document_ids").cast("array<string>"), ",").alias("missing"))


def _metrics_sql(name: str) -> str:
    hits = ", ".join(
        f"round(avg(case when {name}_rank <= {k} then 1.0::double else 0 end), 6) as hit_at_{k}"
        for k in (1, 3, 5, 10))
    recalls = ", ".join(
        f"round(avg(coalesce(len(list_intersect({name}_docs[1:{k}], req)), 0)::double / len(req)),"
        f" 6) as recall_at_{k}" for k in (3, 5, 10))
    return (f"select '{name}' as ranking, count(*) as cases, {hits}, {recalls}, "
            f"round(avg(case when {name}_rank <= 10 then 1.0::double / {name}_rank else 0 end), 6)"
            " as mrr_at_10 from judged")


@R.add("g6_retrieval_metrics", CASES_SQL + _metrics_sql("off") + " union all "
       + _metrics_sql("on"))
def _g6(spark, d):
    built = cases(spark, d)
    out = None
    for name in ("off", "on"):
        part = re_.retrieval_metrics(built, f"{name}_document_ids").withColumn(
            "ranking", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("ranking", "cases", *[
        F.round(c, 6).alias(c) for c in out.columns if c not in ("ranking", "cases")])


def ranks(spark, d):
    built = cases(spark, d)
    gold_ids = F.col("required_document_ids")
    return built.select(
        "query_id",
        re_.first_relevant_rank(F.col("off_document_ids"), gold_ids).alias("off_rank"),
        re_.first_relevant_rank(F.col("on_document_ids"), gold_ids).alias("on_rank"),
    )


@R.add("g7_win_tie_loss", CASES_SQL + """
select count(*) filter (on_rank is not null and (off_rank is null or on_rank < off_rank)) as wins,
  count(*) filter (on_rank is not distinct from off_rank) as ties,
  count(*) filter (off_rank is not null and (on_rank is null or on_rank > off_rank)) as losses
from judged""")
def _g7(spark, d):
    return re_.win_tie_loss(ranks(spark, d))


@R.add("g8_rerank_metrics", CASES_SQL + """
select count(*) as cases,
  round(avg(case when off_rank = 1 then 1.0::double else 0 end), 6) as off_rank_hit_at_1,
  round(avg(case when off_rank <= 3 then 1.0::double else 0 end), 6) as off_rank_hit_at_3,
  round(avg(coalesce(1.0::double / off_rank, 0)), 6) as off_rank_mrr_at_10,
  round(avg(case when on_rank = 1 then 1.0::double else 0 end), 6) as on_rank_hit_at_1,
  round(avg(case when on_rank <= 3 then 1.0::double else 0 end), 6) as on_rank_hit_at_3,
  round(avg(coalesce(1.0::double / on_rank, 0)), 6) as on_rank_mrr_at_10,
  count(*) filter (on_rank < off_rank) as wins, count(*) filter (on_rank = off_rank) as ties,
  count(*) filter (on_rank is null or on_rank > off_rank) as losses from judged""")
def _g8(spark, d):
    out = re_.rerank_metrics(ranks(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if "hit" in c or "mrr" in c else c
                        for c in out.columns])


@R.add("g9_latency_stats", """
select event_type, round(quantile_cont(value, 0.5), 6) as value_p50,
  round(quantile_cont(value, 0.95), 6) as value_p95 from events group by 1
union all select 'all', round(quantile_cont(value, 0.5), 6), round(quantile_cont(value, 0.95), 6)
from events""")
def _g9(spark, d):
    events = table(spark, d, "events")
    each = re_.latency_stats(events, "value", ["event_type"])
    total = re_.latency_stats(events, "value").withColumn("event_type", F.lit("all"))
    out = each.unionByName(total)
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("value_p50", "value_p95")])


@R.add("g10_retrieval_report", """
with cases as (
  select event_type = 'error' as failed, event_id % 2 = 0 as attempted,
    event_id % 34 = 0 as rerank_failed, user_id, value from events)
select count(*) as sample_count, count(*) filter (not failed) as retrieval_successes,
  count(*) filter (failed) as retrieval_failures,
  count(*) filter (attempted) as rerank_live_calls,
  count(*) filter (rerank_failed) as rerank_failures,
  count(*) filter (attempted) - count(*) filter (rerank_failed) as rerank_successes,
  (sum(user_id) filter (attempted))::bigint as rerank_total_tokens,
  round(quantile_cont(value, 0.5) filter (not failed), 6) as retrieval_latency_ms_p50,
  round(quantile_cont(value, 0.95) filter (not failed), 6) as retrieval_latency_ms_p95,
  round(quantile_cont(value * 2, 0.5) filter (attempted), 6) as rerank_latency_ms_p50,
  round(quantile_cont(value * 2, 0.95) filter (attempted), 6) as rerank_latency_ms_p95
from cases""")
def _g10(spark, d):
    failed, attempted = F.col("event_type") == "error", F.col("event_id") % 2 == 0
    rows = table(spark, d, "events").select(
        F.when(failed, "timeout").alias("retrieval_error_code"),
        attempted.alias("rerank_attempted"),
        F.when(F.col("event_id") % 34 == 0, "protocol").alias("rerank_error_code"),
        F.when(attempted, F.col("user_id")).alias("rerank_total_tokens"),
        F.when(~failed, F.col("value")).alias("retrieval_latency_ms"),
        F.when(attempted, F.col("value") * 2).alias("rerank_latency_ms"),
    )
    out = re_.retrieval_report(rows)
    return out.select(*[F.round(c, 6).alias(c) if "latency" in c else c for c in out.columns])


def _runs_to_merge(spark, d):
    e = F.col("event_id")
    base = table(spark, d, "events")

    def run(offset: int):
        return base.where((e % 23 != offset)).select(
            e.alias("query_id"),
            F.when(e % 19 == offset, "other").otherwise("set").alias("dataset_id"),
            F.when((e % 29 == 0) & (F.lit(offset) == 1), F.array(F.lit("x")))
            .otherwise(F.array("event_type")).alias("required_document_ids"),
            F.array(F.concat(F.lit(f"{offset}-"), "event_type")).alias("document_ids"),
            F.when(e % 31 == offset, "timeout").alias("retrieval_error_code"),
            (F.col("value") + offset).alias("retrieval_latency_ms"),
            (e % 2 == 0).alias("rerank_attempted"),
            F.lit(None).cast("string").alias("rerank_error_code"),
            F.col("value").alias("rerank_latency_ms"),
            F.col("user_id").alias("rerank_total_tokens"),
        )

    return run(0), run(1)


MERGE_SQL = """with pairs as (
  select event_id as query_id, event_id % 23 <> 0 as has_off, event_id % 23 <> 1 as has_on,
    event_type, value, user_id from events),
coded as (
  select *, case when not has_off then 'missing_in_off' when not has_on then 'missing_in_on'
    when query_id % 19 in (0, 1) then 'dataset_differs'
    when query_id % 31 in (0, 1) then 'retrieval_failed'
    when query_id % 29 = 0 then 'required_documents_differ' end as code from pairs)"""


@R.add("g11_merge_reports", MERGE_SQL + """
select query_id, event_type as required, '0-' || event_type as off_docs, '1-' || event_type
  as on_docs, value as retrieval_latency_ms, query_id % 2 = 0 as rerank_attempted,
  value as rerank_latency_ms, user_id as rerank_total_tokens from coded where code is null""")
def _g11(spark, d):
    merged, _ = re_.merge_reports(*_runs_to_merge(spark, d))
    return merged.select(
        "query_id", F.array_join("required_document_ids", ",").alias("required"),
        F.array_join("off_document_ids", ",").alias("off_docs"),
        F.array_join("on_document_ids", ",").alias("on_docs"),
        "retrieval_latency_ms", "rerank_attempted", "rerank_latency_ms", "rerank_total_tokens")


@R.add("g11_merge_violations", MERGE_SQL
       + "select query_id, code from coded where code is not null")
def _g11v(spark, d):
    return re_.merge_reports(*_runs_to_merge(spark, d))[1]


# --- intents --------------------------------------------------------------------------------

def intent_samples(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("query_id"),
        F.col("event_type").alias("intent_l1"),
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 3).cast("string")).alias(
            "intent_l2"),
        F.col("event_type").isin("view", "click", "purchase").alias("requires_rag"),
    )


def intent_cases(spark, d, threshold=0.75, margin=0.10):
    decided = u.select_route(intent_scores(spark, d), threshold, margin).select(
        F.col("request_id").alias("query_id"), "route", "reason", "degradation_reason",
        "system_direct_score", "knowledge_base_score", "clarification_score",
        F.col("user_id").alias("input_tokens"), (F.col("user_id") % 7).alias("output_tokens"),
    )
    return ie.judge_intents(intent_samples(spark, d), decided)


def cases_sql(threshold="0.75", margin="0.1", name="intent_cases"):
    return decision_sql("scores", threshold, margin, f"{name}_d") + f""",
{name} as (
  select request_id as query_id, event_type as intent_l1,
    event_type || '_' || (user_id % 3) as intent_l2, user_id as input_tokens,
    user_id % 7 as output_tokens, reason, route as actual_route, degradation_reason,
    case when event_type in ('view', 'click', 'purchase') then 'knowledge_base'
      else 'system_direct' end as expected_route,
    degradation_reason is null and route = case when event_type in ('view', 'click', 'purchase')
      then 'knowledge_base' else 'system_direct' end as correct
  from {name}_d)"""


INTENT_SQL = "with " + SCORES_SQL + ", " + cases_sql()
ACCURACY = ("count(*) as sample_count, count(*) filter (correct) as correct_count, "
            "round((count(*) filter (correct))::double / count(*), 6) as accuracy")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@R.add("g12_judge_intents", INTENT_SQL + """
select query_id, expected_route, actual_route, reason, correct from intent_cases""")
def _g12(spark, d):
    return intent_cases(spark, d).select(
        "query_id", "expected_route", "actual_route", "reason", "correct")


@R.add("g13_intent_accuracy", INTENT_SQL + f"""
select 'overall' as slice, {ACCURACY} from intent_cases
union all select case when expected_route = 'knowledge_base' then 'rag' else 'no_rag' end,
  {ACCURACY} from intent_cases group by 1
union all select 'intent_l1=' || intent_l1, {ACCURACY} from intent_cases group by 1
union all select intent_l2, {ACCURACY} from intent_cases group by 1""")
def _g13(spark, d):
    members = intent_samples(spark, d).select("query_id", F.col("intent_l2").alias("slice"))
    return _rounded(ie.intent_accuracy(intent_cases(spark, d), members), "accuracy")


@R.add("g14_confusion", INTENT_SQL + """,
routes as (select unnest(['system_direct', 'knowledge_base', 'clarification']) as r)
select e.r as expected_route, a.r as actual_route, count(c.query_id) as n
from routes e cross join routes a left join intent_cases c
  on c.expected_route = e.r and c.actual_route = a.r group by 1, 2""")
def _g14(spark, d):
    return ie.confusion(intent_cases(spark, d))


GRID = [(t, m) for t in (0.5, 0.6, 0.7, 0.75, 0.8, 0.9) for m in (0.0, 0.05, 0.1, 0.2)]


def _replay_sql() -> str:
    points = ", ".join(f"({t}::double, {m}::double)" for t, m in GRID)
    return f"""with {SCORES_SQL}, grid(threshold, margin) as (values {points}),
replayed as (select s.*, g.threshold, g.margin from scores s, grid g),
{decision_sql("replayed", "threshold", "margin")},
judged as (
  select *, case when event_type in ('view', 'click', 'purchase') then 'knowledge_base'
      else 'system_direct' end as expected from decisions),
counted as (select *, degradation_reason is null and route = expected as correct from judged)
select threshold, margin, count(*) as sample_count,
  count(*) filter (correct) as correct_count,
  count(*) filter (correct and expected = 'knowledge_base') as rag_correct,
  count(*) filter (correct and expected = 'system_direct') as no_rag_correct,
  count(*) filter (route = 'system_direct') as to_system_direct,
  count(*) filter (route = 'knowledge_base') as to_knowledge_base,
  count(*) filter (route = 'clarification') as to_clarification,
  round((count(*) filter (correct))::double / count(*), 6) as accuracy
from counted group by 1, 2"""


@R.add("g15_replay_thresholds", _replay_sql())
def _g15(spark, d):
    return _rounded(ie.replay_thresholds(intent_cases(spark, d), GRID), "accuracy")


ERRORS = """count(*) filter (expected_route = 'system_direct' and actual_route = 'knowledge_base')
    as over_retrieval,
  count(*) filter (expected_route = 'knowledge_base' and actual_route = 'system_direct')
    as under_retrieval,
  count(*) filter (actual_route = 'clarification') as clarification"""


@R.add("g16_route_errors", INTENT_SQL + f"""
select intent_l1, {ERRORS} from intent_cases where not correct group by 1""")
def _g16(spark, d):
    return ie.route_errors(intent_cases(spark, d), by=["intent_l1"])


@R.add("g17_failure_buckets", INTENT_SQL + """
select intent_l1, intent_l2, expected_route, actual_route, reason, count(*) as sample_count
from intent_cases where not correct group by all""")
def _g17(spark, d):
    return ie.failure_buckets(intent_cases(spark, d))


@R.add("g17_failure_members", INTENT_SQL + """
select intent_l1, intent_l2, expected_route, actual_route, reason, query_id
from intent_cases where not correct""")
def _g17m(spark, d):
    return ie.failure_members(intent_cases(spark, d))


@R.add("g17_failure_totals", INTENT_SQL + """
select 'intent_l1' as dimension, intent_l1 as value, count(*) as n from intent_cases
where not correct group by 2
union all select 'reason', reason, count(*) from intent_cases where not correct group by 2""")
def _g17t(spark, d):
    return ie.failure_totals(intent_cases(spark, d))


# --- gates ----------------------------------------------------------------------------------

def members(spark, d):
    """Failures are the baseline's wrong cases, guards its correct purchases."""
    base = intent_cases(spark, d)
    wrong = base.where(~F.col("correct")).select("query_id", F.lit("failure").alias("subset"))
    guard = base.where(F.col("correct") & (F.col("intent_l1") == "purchase")).select(
        "query_id", F.lit("guard").alias("subset"))
    return wrong.unionByName(guard)


CANDIDATES = {"base": (0.75, 0.10), "loose": (0.5, 0.0)}


def candidate_cases(spark, d):
    out = None
    for name, (threshold, margin) in CANDIDATES.items():
        part = intent_cases(spark, d, threshold, margin).withColumn("candidate", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


GATE_SQL = ("with " + SCORES_SQL + ", " + cases_sql() + ", " + cases_sql("0.5", "0.0", "loose")
            + """,
members as (
  select query_id, 'failure' as subset from intent_cases where not correct
  union all select query_id, 'guard' from intent_cases
    where correct and intent_l1 = 'purchase'),
candidates as (
  select 'base' as candidate, * from intent_cases
  union all select 'loose', * from loose),
marked as (
  select c.*, m.subset from candidates c join members m using (query_id)
  union all select c.*, 'full' from candidates c),
metrics as (
  select candidate, subset, count(*) filter (correct) as correct,
    count(*) filter (correct and expected_route = 'knowledge_base') as rag_correct,
    count(*) filter (correct and expected_route = 'system_direct') as no_rag_correct,
    """ + ERRORS + """
  from marked group by 1, 2),
rules(name, subset, comparison, required) as (values
  ('failure_rag_correct', 'failure', 'gte', 8), ('failure_no_rag_correct', 'failure', 'gte', 8),
  ('failure_under_retrieval', 'failure', 'eq', 0), ('guard_correct', 'guard', 'gte', 17),
  ('guard_under_retrieval', 'guard', 'eq', 0), ('full_overall_correct', 'full', 'gt', 128),
  ('full_rag_correct', 'full', 'gte', 121), ('full_no_rag_correct', 'full', 'gt', 7),
  ('full_under_retrieval', 'full', 'eq', 0)),
stages(stage_no, stage, subset) as (values (1, 'failures', 'failure'), (2, 'guard', 'failure'),
  (2, 'guard', 'guard'), (3, 'full', 'failure'), (3, 'full', 'guard'), (3, 'full', 'full')),
actuals as (
  select m.candidate, s.stage_no, s.stage, r.name, r.comparison, r.required::bigint as required,
    case when r.name like '%under_retrieval' then under_retrieval
      when r.name like '%no_rag_correct' then no_rag_correct
      when r.name like '%rag_correct' then rag_correct else correct end as actual
  from metrics m join rules r using (subset) join stages s using (subset)),
checks as (
  select *, case comparison when 'eq' then actual = required when 'gte' then actual >= required
    else actual > required end as passed from actuals)""")


@R.add("g18_gate_checks", GATE_SQL + """
select candidate, stage, name, comparison, actual, required, passed from checks""")
def _g18(spark, d):
    checks, _ = gates.evaluate_gates(candidate_cases(spark, d), members(spark, d),
                                     intent_samples(spark, d))
    return checks.drop("stage_no")


@R.add("g18_stage_gates", GATE_SQL + """,
results as (select candidate, stage_no, stage, count(*) as n_checks, bool_and(passed) as passed
  from checks group by 1, 2, 3)
select candidate, stage, n_checks, true as complete, passed, coalesce(bool_and(passed) over (
  partition by candidate order by stage_no rows between unbounded preceding and 1 preceding), true)
  as unlocked from results""")
def _g18s(spark, d):
    _, result = gates.evaluate_gates(candidate_cases(spark, d), members(spark, d),
                                     intent_samples(spark, d))
    return result.drop("stage_no")


@R.add("g18_zero_error_gate", GATE_SQL + """
select candidate, 'all_routes_correct' as name, count(*) filter (correct) as actual,
  count(*) as required, count(*) filter (correct) = count(*) as passed from candidates group by 1
union all select candidate, 'under_retrieval', under_retrieval, 0, under_retrieval = 0
  from metrics where subset = 'full'
union all select candidate, 'over_retrieval', over_retrieval, 0, over_retrieval = 0
  from metrics where subset = 'full'
union all select candidate, 'clarification', clarification, 0, clarification = 0
  from metrics where subset = 'full'""")
def _g18z(spark, d):
    return gates.zero_error_gate(candidate_cases(spark, d))


@R.add("g19_check_manifest", INTENT_SQL + """,
failures as (select query_id from intent_cases where not correct and input_tokens <> 7
  union all select query_id from intent_cases where correct and input_tokens = 9),
guards as (select query_id from intent_cases where intent_l1 = 'view'),
listed as (select query_id, 'failure' as subset from failures
  union all select query_id, 'guard' from guards),
strata as (select subset, dimension, value, count(*) as n from (
    select l.subset, 'intent_l1' as dimension, c.intent_l1 as value
    from listed l join intent_cases c using (query_id)
    union all select l.subset, 'route', c.expected_route
    from listed l join intent_cases c using (query_id)) group by 1, 2, 3),
found as (
  select 'failure_not_wrong_in_baseline' as code, '' as detail, count(*) as n from intent_cases
    where correct and input_tokens = 9
  union all select 'wrong_case_not_listed', '', count(*) from intent_cases
    where not correct and input_tokens = 7
  union all select 'guard_was_wrong', '', count(*) from intent_cases
    where not correct and intent_l1 = 'view'
  union all select 'strata_drift', subset || '/' || dimension || '/' || value, n from strata
    where not (subset = 'guard' and dimension = 'intent_l1')
  union all select 'strata_drift', 'guard/intent_l1/chat', 0)
select * from found where n > 0 or code = 'strata_drift'""")
def _g19(spark, d):
    base = intent_cases(spark, d)
    wrong, token = ~F.col("correct"), F.col("input_tokens")
    listed = (
        base.where((wrong & (token != 7)) | (F.col("correct") & (token == 9)))
        .select("query_id", F.lit("failure").alias("subset"))
        .unionByName(base.where("intent_l1 = 'view'").select(
            "query_id", F.lit("guard").alias("subset")))
    )
    # Registered strata: right for the guards' first-level intents, wrong for all others.
    views = base.where("intent_l1 = 'view'").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("guard").alias("subset"), F.lit("intent_l1").alias("dimension"),
        F.lit("view").alias("value"), "n")
    chat = spark.range(1).select(F.lit("guard").alias("subset"),
                                 F.lit("intent_l1").alias("dimension"),
                                 F.lit("chat").alias("value"),
                                 F.lit(3).cast("bigint").alias("n"))
    return gates.check_manifest(listed, intent_samples(spark, d), base,
                                views.unionByName(chat))


CACHE_SQL = GATE_SQL + """,
cache as (select * from loose where degradation_reason is null and intent_l1 <> 'signup'
  and input_tokens % 5 <> 0),
target as (select query_id from members)"""


def _cache(spark, d):
    return intent_cases(spark, d, *CANDIDATES["loose"]).where(
        "degradation_reason is null and intent_l1 <> 'signup' and input_tokens % 5 <> 0")


@R.add("g20_pending_cases", CACHE_SQL + """
select query_id from target where query_id not in (select query_id from cache)""")
def _g20(spark, d):
    target = gates.stage_members("guard", members(spark, d), intent_samples(spark, d))
    return gates.pending_cases(target, _cache(spark, d))


@R.add("g21_check_cache", INTENT_SQL + """,
broken as (
  select query_id + case when input_tokens = 3 then 10000000 else 0 end as query_id,
    input_tokens, query_id % 29 = 0 as degraded, expected_route from intent_cases
  union all select query_id + case when input_tokens = 3 then 10000000 else 0 end,
    input_tokens, query_id % 29 = 0, expected_route from intent_cases where input_tokens = 11)
select query_id, 'unknown_query_id' as code from broken where input_tokens = 3
union all select query_id, 'intent_changed' from broken where input_tokens = 5
union all select query_id, 'expected_route_changed' from broken where input_tokens = 8
  and expected_route <> 'clarification'
union all select query_id, 'not_a_success' from broken where degraded
union all select query_id, 'scores_missing' from broken where input_tokens = 13
union all select query_id, 'query_id_repeated' from broken group by query_id
  having count(*) > 1""")
def _g21(spark, d):
    t = F.col("input_tokens")
    base = intent_cases(spark, d)
    broken = base.unionByName(base.where(t == 11)).withColumns({
        "query_id": F.col("query_id") + F.when(t == 3, 10000000).otherwise(0),
        "intent_l1": F.when(t == 5, "other").otherwise(F.col("intent_l1")),
        "expected_route": F.when(t == 8, "clarification").otherwise(F.col("expected_route")),
        "clarification_score": F.when(t != 13, F.col("clarification_score")),
    })
    return gates.check_cache(broken, intent_samples(spark, d),
                             [f"{r}_score" for r in
                              ("system_direct", "knowledge_base", "clarification")])


@R.add("g22_fingerprint", """
select event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type
  || '","odd":' || coalesce(case when event_id % 2 = 1 then 'true' end, 'null')
  || ',"user_id":' || user_id || '}') as fingerprint from events""")
def _g22(spark, d):
    rows = table(spark, d, "events").withColumn("odd", F.when(F.col("event_id") % 2 == 1, True))
    return gates.fingerprint(rows, ["user_id", "event_type", "odd", "event_id"]).select(
        "event_id", "fingerprint")


@R.add("g22_table_fingerprint", """
select count(*) as rows, bit_xor(h) as hash_xor, sum(h)::varchar as hash_sum from (
  select ('0x' || substr(sha256('{"event_id":' || event_id || ',"event_type":"' || event_type
    || '","user_id":' || user_id || '}'), 1, 15))::bigint as h from events)""")
def _g22t(spark, d):
    out = gates.table_fingerprint(table(spark, d, "events"), ["event_id", "user_id", "event_type"])
    return out.withColumn("hash_sum", F.col("hash_sum").cast("string"))


@R.add("g23_check_challenge", r"""
with mine as (select doc_id // 2 as query_id, lower(regexp_replace(text, '\s', '', 'g')) as q
  from documents),
theirs as (select l.doc_id * 3 as query_id, lower(regexp_replace(d.text, '\s', '', 'g')) as q
  from labels l join documents d using (doc_id))
select 'query_id_repeated' as code, (count(*) - count(distinct query_id)) as n from mine
union all select 'question_repeated', count(*) - count(distinct q) from mine
union all select 'query_id_reused', count(*) from mine
  where query_id in (select query_id from theirs)
union all select 'question_reused', count(*) from mine where q in (select q from theirs)""")
def _g23(spark, d):
    docs = table(spark, d, "documents")
    mine = docs.select(F.expr("doc_id div 2").alias("query_id"),
                       F.concat(F.lit(" "), "text", F.lit("\n")).alias("query"))
    theirs = table(spark, d, "labels").join(docs, "doc_id").select(
        (F.col("doc_id") * 3).alias("query_id"), F.col("text").alias("query"))
    return gates.check_challenge(mine, theirs)


@R.add("g23_challenge_balance", INTENT_SQL + """
select expected_route, count(*) as n, count(*) filter (
  (expected_route = 'knowledge_base') <> (intent_l2 like '%_0')) as boundary_errors
from intent_cases group by 1""")
def _g23b(spark, d):
    rows = intent_cases(spark, d).withColumn(
        "intent_l1", F.when(F.col("intent_l2").endswith("_0"), "SUPPORT").otherwise("CHAT"))
    return gates.challenge_balance(rows)


@R.add("g24_stage_report", CACHE_SQL + """,
done as (select * from cache where query_id in (select query_id from target))
select count(*) as cases, count(*) filter (correct) as correct,
  count(*) filter (expected_route = 'knowledge_base') as rag_cases,
  count(*) filter (expected_route = 'knowledge_base' and correct) as rag_correct,
  count(*) filter (expected_route = 'system_direct') as no_rag_cases,
  count(*) filter (expected_route = 'system_direct' and correct) as no_rag_correct,
  sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens,
  """ + ERRORS + """,
  (select count(*) from target) as target,
  (select count(*) from target where query_id in (select query_id from cache
    where input_tokens % 2 = 0)) as reused,
  (select count(*) from cache) as total_cached,
  (select count(*) from scores where degradation_reason is not null) as failed_attempts,
  (select count(*) from target) - (select count(*) from target where query_id in (
    select query_id from cache where input_tokens % 2 = 0)) as new_calls,
  (select count(*) from cache) + (select count(*) from scores
    where degradation_reason is not null) as total_attempts,
  (select count(*) from scores) - (select count(*) from cache) as remaining,
  count(*) = (select count(*) from target) as complete,
  round((count(*) filter (correct))::double / count(*), 6) as accuracy
from done""")
def _g24(spark, d):
    cache, sample = _cache(spark, d), intent_samples(spark, d)
    target = gates.stage_members("guard", members(spark, d), sample)
    failed = intent_scores(spark, d).where("degradation_reason is not null")
    return _rounded(gates.stage_report(target, sample, cache, cache.where(
        "input_tokens % 2 = 0"), failed), "accuracy")
