"""Queries over model answers: rewriting, intents, routes, model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from askgrid.functions.routes import DEFAULT_GUIDANCE
from askgrid.operators import prompt, understanding as u
from askgrid.workload.data import Registry, table
from askgrid.workload.retrieval import ESCAPE

R = Registry()

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def rewrite_requests(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"), F.col("text").alias("question"))


def rewrite_responses(spark, d):
    """A model answer per document: good ones and six kinds of bad or unusual ones."""
    i, t = F.col("doc_id") % 7, F.col("text")

    def answer(question, *subs):
        return F.to_json(F.struct(question.alias("rewritten_question"),
                                  F.array(*subs).alias("sub_questions")))

    b, c = F.concat(t, F.lit(" b")), F.concat(F.lit("c "), t)
    content = (
        F.when(i == 0, answer(t, t, b))
        .when(i == 1, F.to_json(F.struct(t.alias("rewritten_question"),
                                         F.array(t).alias("sub_questions"),
                                         F.lit(1).alias("note"))))
        .when(i == 2, answer(t, t, F.concat(F.lit(" "), t)))
        .when(i == 3, F.concat(F.lit('{"rewritten_question": '), F.to_json(F.array(t))))
        .when(i == 4, F.concat(F.lit('{"rewritten_question": 5, "sub_questions": '),
                               F.to_json(F.array(t)), F.lit("}")))
        .when(i == 5, answer(F.lit("  "), t))
        .otherwise(answer(t, t, b, c))
    )
    return table(spark, d, "documents").select(F.col("doc_id").alias("request_id"),
                                               content.alias("content"))


PARSED_SQL = f"""with parsed as (
  select doc_id as request_id, text, {TRIM.format('text')} as q,
    {TRIM.format("text || ' b'")} as b, {TRIM.format("'c ' || text")} as c,
    case when doc_id % 7 = 0 then length({TRIM.format("text || ' b'")}) <= 10000
      when doc_id % 7 = 6 then length({TRIM.format("text || ' b'")}) <= 10000
      else false end as valid
  from documents)"""


@R.add("e1_parse_rewrites", PARSED_SQL + """
select request_id, valid, case when valid then sha256(q) end as question_sha256,
  case when valid then sha256(case when request_id % 7 = 0 then q || '|' || b
    else q || '|' || b || '|' || c end) end as subs_sha256 from parsed""")
def _e1(spark, d):
    return u.parse_rewrites(rewrite_responses(spark, d)).select(
        "request_id", "valid", F.sha2("rewritten_question", 256).alias("question_sha256"),
        F.sha2(F.array_join("sub_questions", "|"), 256).alias("subs_sha256"))


CALLED_SQL = """case request_id % 10 when 8 then 'timeout' when 9 then 'model_failure'
  else 'ok' end"""


def _calls(requests):
    i = F.col("request_id") % 10
    return requests.select("request_id", F.when(i == 8, "timeout").when(i == 9, "model_failure")
                           .otherwise("ok").alias("call_status"))


@R.add("e2_apply_rewrites", PARSED_SQL + f"""
select request_id, case when {CALLED_SQL} = 'timeout' then 'query_rewrite_timeout'
    when {CALLED_SQL} = 'model_failure' then 'query_rewrite_model_failure'
    when not valid then 'query_rewrite_protocol' end as degradation_reason,
  case when valid and {CALLED_SQL} = 'ok' then case request_id % 7 when 0 then 2 else 3 end
    else 1 end as n_questions,
  sha256(q) as question_sha256 from parsed""")
def _e2(spark, d):
    requests = rewrite_requests(spark, d)
    out = u.apply_rewrites(requests, _calls(requests),
                           u.parse_rewrites(rewrite_responses(spark, d)))
    return out.select("request_id", "degradation_reason",
                      F.size("sub_questions").alias("n_questions"),
                      F.sha2("rewritten_question", 256).alias("question_sha256"))


def score(a: int, b: int):
    return ((F.col("event_id") * a + b) % 101) / 100


def intent_scores(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), "event_type", "user_id", "value", "ts",
        score(37, 0).alias("system_direct_score"),
        score(53, 17).alias("knowledge_base_score"),
        score(71, 5).alias("clarification_score"),
        F.when(F.col("event_id") % 29 == 0, "intent_classifier_timeout").alias(
            "degradation_reason"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("which "), "event_type")).alias(
            "clarification_question"),
    )


def decisions(spark, d):
    return u.select_route(intent_scores(spark, d))


SCORES_SQL = """scores as (
  select event_id as request_id, event_type, user_id, value, ts,
    ((event_id * 37) % 101) / 100 as sd, ((event_id * 53 + 17) % 101) / 100 as kb,
    ((event_id * 71 + 5) % 101) / 100 as cl,
    case when event_id % 29 = 0 then 'intent_classifier_timeout' end as degradation_reason,
    case when event_id % 2 = 0 then 'which ' || event_type end as clarification_question
  from events)"""


def decision_sql(source: str, threshold: str = "0.75", margin: str = "0.1",
                 name: str = "decisions") -> str:
    return f"""{name}_top as (
  select *, greatest(sd, kb, cl) as top,
    case when sd >= kb and sd >= cl then 'system_direct' when kb >= cl then 'knowledge_base'
      else 'clarification' end as top_route,
    greatest(sd, kb, cl) - list_sort([sd, kb, cl])[2] as gap from {source}),
{name}_reason as (
  select *, case when degradation_reason is not null then 'classifier_fallback'
    when top < {threshold} then 'low_confidence'
    when gap < {margin} and abs(gap - {margin}) > 1e-12 then 'ambiguous'
    when top_route = 'clarification' then 'explicit_clarification'
    else 'high_confidence' end as reason from {name}_top),
{name} as (
  select *, case reason when 'classifier_fallback' then 'knowledge_base'
    when 'high_confidence' then top_route else 'clarification' end as route
  from {name}_reason)"""


DECISIONS_SQL = "with " + SCORES_SQL + ", " + decision_sql("scores")


def intent_responses(spark, d):
    """Classifier answers as JSON text: every eighth of the events is broken another way."""
    i = F.col("event_id") % 8
    s, k, c = (score(37, 0), score(53, 17), score(71, 5))

    def obj(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    scores = obj('{"knowledge_base": ', k.cast("string"), ', "system_direct": ',
                 s.cast("string"), ', "clarification": ', c.cast("string"), "}")
    content = (
        F.when(i == 0, obj('{"scores": ', scores, ', "clarification_question": null}'))
        .when(i == 1, obj('{"scores": ', scores, "}"))
        .when(i == 2, obj('{"scores": ', F.replace(scores, F.lit("}"), F.lit(', "other": 0.1}')),
                          ', "clarification_question": null}'))
        .when(i == 3, obj('{"clarification_question": " which? ", "scores": ', scores, "}"))
        .when(i == 4, obj('{"scores": {"system_direct": true, "knowledge_base": ',
                          k.cast("string"), ', "clarification": 0.5}, ',
                          '"clarification_question": null}'))
        .when(i == 5, obj('{"scores": {"system_direct": 1.5, "knowledge_base": 0.1, ',
                          '"clarification": 0}, "clarification_question": null}'))
        .when(i == 6, obj('{"scores": ', scores, ', "clarification_question": "  "}'))
        .otherwise(obj('{"scores": ', scores, ', "clarification_question": null'))
    )
    return table(spark, d, "events").select(F.col("event_id").alias("request_id"),
                                            content.alias("content"))


@R.add("e3_parse_intents", "with " + SCORES_SQL + """
select request_id, request_id % 8 in (0, 3) as valid,
  case when request_id % 8 in (0, 3) then sd end as system_direct_score,
  case when request_id % 8 in (0, 3) then kb end as knowledge_base_score,
  case when request_id % 8 in (0, 3) then cl end as clarification_score,
  case when request_id % 8 = 3 then 'which?' end as clarification_question from scores""")
def _e3(spark, d):
    return u.parse_intents(intent_responses(spark, d))


@R.add("e4_select_route", "with " + SCORES_SQL.replace(
    "case when event_id % 29 = 0 then 'intent_classifier_timeout' end", "null") + ", "
    + decision_sql("scores") + f"""
select request_id, route, reason, case when route = 'clarification' then
  coalesce(clarification_question, '{DEFAULT_GUIDANCE}') end as guidance from decisions""")
def _e4(spark, d):
    out = u.select_route(intent_scores(spark, d).drop("degradation_reason"))
    return out.select("request_id", "route", "reason", "guidance")


@R.add("e5_classifier_fallback", "with " + SCORES_SQL + """, called as (
  select *, request_id % 8 in (0, 3) as valid from scores),
judged as (select * exclude (degradation_reason), case when """ + CALLED_SQL + """ = 'timeout'
    then 'intent_classifier_timeout' when """ + CALLED_SQL + """ = 'model_failure'
    then 'intent_classifier_model_failure' when not valid then 'intent_classifier_protocol' end
    as degradation_reason from called), """ + decision_sql("judged") + """
select request_id, route, reason, degradation_reason from decisions""")
def _e5(spark, d):
    requests = table(spark, d, "events").select(F.col("event_id").alias("request_id"))
    out = u.apply_intents(requests, _calls(requests), u.parse_intents(intent_responses(spark, d)))
    return out.select("request_id", "route", "reason", "degradation_reason")


@R.add("e6_bind_scope", DECISIONS_SQL + """
select request_id, route, case when reason <> 'classifier_fallback' and route = 'knowledge_base'
  then 'returns,orders' else '' end as slugs from decisions""")
def _e6(spark, d):
    tree = spark.createDataFrame(
        [("knowledge_base", [" Returns", "orders", "returns"]), ("system_direct", []),
         ("clarification", [])],
        "route string, knowledge_base_slugs array<string>",
    )
    return u.bind_scope(decisions(spark, d), tree).select(
        "request_id", "route", F.array_join("slugs", ",").alias("slugs"))


@R.add("e7_split_by_route", DECISIONS_SQL + """
select route as branch, reason, count(*) as n, sum(request_id) as id_sum from decisions
group by 1, 2""")
def _e7(spark, d):
    branches = u.split_by_route(decisions(spark, d))
    out = None
    for name, rows in branches.items():
        part = rows.groupBy("reason").agg(
            F.count(F.lit(1)).alias("n"), F.sum("request_id").alias("id_sum")
        ).withColumn("branch", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# --- model inputs ---------------------------------------------------------------------------

def talks(spark, d):
    """Per user message: the previous message as memory, and a summary for some."""
    rows = table(spark, d, "conversations")
    earlier = rows.select(
        "conv_id", (F.col("turn") + 1).alias("turn"),
        F.array(F.struct(F.col("turn").alias("ordinal"), "role", F.col("text").alias("content")))
        .alias("messages"))
    return rows.join(earlier, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"),
        F.col("text").alias("question"), F.col("text").alias("rewritten_question"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("<conv> "), F.col("conv_id").cast(
            "string"))).alias("summary"),
        "messages",
    )


TALKS_SQL = f"""with talks as (
  select c.conv_id * 100 + c.turn as request_id, {ESCAPE.format(TRIM.format('c.text'))} as q,
    {ESCAPE.format('c.text')} as raw,
    case when c.conv_id % 3 = 0 then '&lt;conv&gt; ' || c.conv_id else '无' end as s,
    p.role, p.turn as ordinal, {ESCAPE.format('p.text')} as m
  from conversations c left join conversations p
    on p.conv_id = c.conv_id and p.turn = c.turn - 1)
"""


def _hashed(df):
    return df.select("request_id", F.sha2("model_input", 256).alias("input_sha256"))


@R.add("e8_rewrite_inputs", TALKS_SQL + """
select request_id, sha256('<conversation_summary>' || chr(10) || s || chr(10)
  || '</conversation_summary>' || chr(10) || '<conversation_messages>' || chr(10)
  || coalesce('<message index="1" role="' || role || '">' || m || '</message>', '无') || chr(10)
  || '</conversation_messages>' || chr(10) || '<current_question>' || chr(10) || q || chr(10)
  || '</current_question>') as input_sha256 from talks""")
def _e8a(spark, d):
    return _hashed(prompt.rewrite_inputs(talks(spark, d)))


@R.add("e8_direct_inputs", TALKS_SQL + """
select request_id, sha256('<conversation_memory>' || chr(10) || '<summary>' || s || '</summary>'
  || chr(10) || coalesce('<message index="1" role="' || role || '">' || m || '</message>', '无')
  || chr(10) || '</conversation_memory>' || chr(10) || '<current_question>' || chr(10) || raw
  || chr(10) || '</current_question>') as input_sha256 from talks""")
def _e8b(spark, d):
    return _hashed(prompt.direct_inputs(talks(spark, d)))


@R.add("e8_summary_inputs", TALKS_SQL + """
select request_id, sha256('<previous_summary>' || chr(10) || s || chr(10)
  || '</previous_summary>' || chr(10) || '<messages>' || chr(10)
  || coalesce('<message ordinal="' || ordinal || '" role="' || role || '">' || m || '</message>',
    '') || chr(10) || '</messages>') as input_sha256 from talks""")
def _e8c(spark, d):
    return _hashed(prompt.summary_inputs(
        talks(spark, d).withColumnRenamed("summary", "previous_summary")))


@R.add("e8_intent_inputs", TALKS_SQL + """
select request_id, sha256('<intent_tree version="v&amp;1">' || chr(10)
  || '<intent name="system_direct">greetings</intent>' || chr(10)
  || '<intent name="knowledge_base">facts &lt;kb&gt;</intent>' || chr(10)
  || '<intent name="clarification">unclear</intent>' || chr(10) || '</intent_tree>' || chr(10)
  || '<rewritten_question>' || chr(10) || q || chr(10) || '</rewritten_question>')
  as input_sha256 from talks""")
def _e8d(spark, d):
    tree = {"system_direct": "greetings", "knowledge_base": "facts <kb>",
            "clarification": "unclear"}
    return _hashed(prompt.intent_inputs(talks(spark, d), "v&1", tree))
