import json

import pytest

from askgrid.operators import understanding as u
from conftest import rows

SCORES = ("system_direct_score double, knowledge_base_score double, "
          "clarification_score double")


@pytest.mark.parametrize("scores,route,reason", [
    ((0.9, 0.05, 0.05), "system_direct", "high_confidence"),
    ((0.1, 0.85, 0.05), "knowledge_base", "high_confidence"),
    ((0.1, 0.1, 0.8), "clarification", "explicit_clarification"),
    ((0.7, 0.1, 0.2), "clarification", "low_confidence"),
    ((0.1, 0.2, 0.7), "clarification", "low_confidence"),
    ((0.8, 0.75, 0.1), "clarification", "ambiguous"),
    ((0.85, 0.75, 0.0), "system_direct", "high_confidence"),  # lead equals the margin
    ((0.75, 0.65, 0.0), "system_direct", "high_confidence"),
    ((0.75, 0.0, 0.0), "system_direct", "high_confidence"),
    ((0.8, 0.8, 0.8), "clarification", "ambiguous"),
])
def test_route_policy(spark, scores, route, reason):
    out = u.select_route(spark.createDataFrame([scores], SCORES)).first()
    assert (out["route"], out["reason"]) == (route, reason)
    assert (out["guidance"] is not None) == (route == "clarification")


def test_equal_scores_follow_the_route_order(spark):
    df = spark.createDataFrame([(0.8, 0.8, 0.1)], SCORES)
    assert u.select_route(df, margin=0.0).first()["route"] == "system_direct"


GOOD = {"rewritten_question": " q ", "sub_questions": ["a", " b "]}


@pytest.mark.parametrize("content,valid", [
    (json.dumps(GOOD), True),
    (json.dumps({**GOOD, "sub_questions": ["a"]}), True),
    (json.dumps({**GOOD, "x": 1}), False),
    (json.dumps({"rewritten_question": "q"}), False),
    (json.dumps({**GOOD, "sub_questions": []}), False),
    (json.dumps({**GOOD, "sub_questions": ["a", "b", "c", "d"]}), False),
    (json.dumps({**GOOD, "sub_questions": ["a", " a"]}), False),
    (json.dumps({**GOOD, "sub_questions": ["a", 1]}), False),
    (json.dumps({**GOOD, "sub_questions": ["a", " "]}), False),
    (json.dumps({**GOOD, "rewritten_question": 3}), False),
    (json.dumps({**GOOD, "rewritten_question": "x" * 10_001}), False),
    (json.dumps([GOOD]), False),
    ("not json", False),
    (None, False),
])
def test_rewrite_answers(spark, content, valid):
    df = spark.createDataFrame([(1, content)], "request_id long, content string")
    out = u.parse_rewrites(df).first()
    assert out["valid"] is valid
    assert (out["rewritten_question"] == "q") is valid


SC = {"system_direct": 0.1, "knowledge_base": 1, "clarification": 0}


@pytest.mark.parametrize("content,valid,question", [
    ({"scores": SC, "clarification_question": None}, True, None),
    ({"scores": SC, "clarification_question": " which? "}, True, "which?"),
    ({"scores": SC, "clarification_question": ""}, False, None),
    ({"scores": SC, "clarification_question": "x" * 1001}, False, None),
    ({"scores": SC, "clarification_question": 5}, False, None),
    ({"scores": SC}, False, None),
    ({"scores": {**SC, "system_direct": True}, "clarification_question": None}, False, None),
    ({"scores": {**SC, "system_direct": "0.1"}, "clarification_question": None}, False, None),
    ({"scores": {**SC, "system_direct": 1.01}, "clarification_question": None}, False, None),
    ({"scores": {**SC, "other": 0}, "clarification_question": None}, False, None),
    ({"scores": [0.1], "clarification_question": None}, False, None),
])
def test_intent_answers(spark, content, valid, question):
    df = spark.createDataFrame([(1, json.dumps(content))], "request_id long, content string")
    out = u.parse_intents(df).first()
    assert (out["valid"], out["clarification_question"]) == (valid, question)


def test_rewrite_fallback_reasons(spark):
    requests = spark.createDataFrame([(i, f" q{i} ") for i in range(5)],
                                     "request_id long, question string")
    calls = spark.createDataFrame([(0, "ok"), (1, "timeout"), (2, "model_failure"), (3, "ok")],
                                  "request_id long, call_status string")
    parsed = spark.createDataFrame([(0, "new", ["s"], True), (1, "new", ["s"], True)],
                                   "request_id long, rewritten_question string, "
                                   "sub_questions array<string>, valid boolean")
    out = u.apply_rewrites(requests, calls, parsed)
    assert rows(out, "request_id", "rewritten_question", "degradation_reason") == [
        (0, "new", None), (1, "q1", "query_rewrite_timeout"),
        (2, "q2", "query_rewrite_model_failure"), (3, "q3", "query_rewrite_protocol"),
        (4, "q4", "query_rewrite_model_failure")]
