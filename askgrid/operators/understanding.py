"""Parse model answers for rewriting and intent, choose routes, and fall back with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.routes import (
    AMBIGUITY_MARGIN,
    CONFIDENCE_THRESHOLD,
    DEFAULT_GUIDANCE,
    ROUTES,
    decide,
    score_profile,
)
from askgrid.functions.lets import computed_once, let
from askgrid.functions.text import strip

MAX_QUESTION_CHARS = 10_000
MAX_GUIDANCE_CHARS = 1_000
MAX_SUB_QUESTIONS = 3
# Degradation reasons by the status of the model call.
REWRITE_REASONS = {
    "timeout": "query_rewrite_timeout",
    "model_failure": "query_rewrite_model_failure",
    "protocol": "query_rewrite_protocol",
}
INTENT_REASONS = {
    "timeout": "intent_classifier_timeout",
    "model_failure": "intent_classifier_model_failure",
    "protocol": "intent_classifier_protocol",
}
_NUMBER = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"


def parse_rewrites(responses: DataFrame, max_sub_questions: int = MAX_SUB_QUESTIONS) -> DataFrame:
    """``(request_id, rewritten_question, sub_questions, valid)`` from ``request_id, content``.

    The answer must be one JSON object with exactly the two keys; types are checked on the
    parsed value, so a number is not taken for a text. Null fields where not ``valid``.
    """
    shape = r"^OBJECT<rewritten_question: STRING, sub_questions: ARRAY<STRING>>$"
    value = F.try_parse_json("content")
    parsed = computed_once(responses.select("request_id", "content"), {"_v": value})
    typed = computed_once(parsed.select("request_id", "_v"), {
        "_p": F.when(
            F.schema_of_variant("_v").rlike(shape),
            F.struct(
                strip(F.variant_get("_v", "$.rewritten_question", "string")).alias("q"),
                F.transform(
                    F.variant_get("_v", "$.sub_questions", "array<string>"), strip
                ).alias("subs"),
            ),
        ),
    })

    def good(text: Column) -> Column:
        return (F.length(text) > 0) & (F.length(text) <= MAX_QUESTION_CHARS)

    subs = F.col("_p.subs")
    valid = F.coalesce(
        F.col("_p").isNotNull()
        & good(F.col("_p.q"))
        & F.size(subs).between(1, max_sub_questions)
        & F.forall(subs, good)
        & (F.size(F.array_distinct(subs)) == F.size(subs)),
        F.lit(False),
    )
    judged = computed_once(typed, {"valid": valid})
    valid = F.col("valid")
    return judged.select(
        "request_id",
        F.when(valid, F.col("_p.q")).alias("rewritten_question"),
        F.when(valid, subs).alias("sub_questions"),
        "valid",
    )


def apply_rewrites(requests: DataFrame, calls: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rewritten or original question per request, with the reason for falling back.

    ``calls``: ``request_id, call_status`` with ``ok``, ``timeout`` or ``model_failure``; a
    request without a call counts as a model failure.
    """
    status = F.coalesce("call_status", F.lit("model_failure"))
    reason = (
        F.when(status == "timeout", REWRITE_REASONS["timeout"])
        .when(status != "ok", REWRITE_REASONS["model_failure"])
        .when(~F.coalesce("valid", F.lit(False)), REWRITE_REASONS["protocol"])
    )
    original = strip(F.col("question"))
    return (
        requests.join(calls, "request_id", "left")
        .join(parsed, "request_id", "left")
        .withColumn("degradation_reason", reason)
        .withColumns({
            "rewritten_question": F.when(
                F.col("degradation_reason").isNull(), F.col("rewritten_question")
            ).otherwise(original),
            "sub_questions": F.when(
                F.col("degradation_reason").isNull(), F.col("sub_questions")
            ).otherwise(F.array(original)),
        })
        .drop("call_status", "valid")
    )


def parse_intents(responses: DataFrame) -> DataFrame:
    """``(request_id, <route>_score x3, clarification_question, valid)`` from ``content``.

    Exactly the two keys, exactly the three routes, JSON numbers in [0, 1] (a JSON boolean is
    not a number), and a null or 1 to 1000 character question.
    """
    fields = ", ".join(f"{route}: {_NUMBER}" for route in sorted(ROUTES))
    shape = rf"^OBJECT<clarification_question: (VOID|STRING), scores: OBJECT<{fields}>>$"
    parsed = computed_once(
        responses.select("request_id", "content"), {"_v": F.try_parse_json("content")})
    typed = computed_once(parsed.select("request_id", "_v"), {
        "_v": F.col("_v"),
        "_shaped": F.coalesce(F.schema_of_variant("_v").rlike(shape), F.lit(False)),
    })
    scores = {
        route: F.when(F.col("_shaped"), F.variant_get("_v", f"$.scores.{route}", "double"))
        for route in ROUTES
    }
    question = F.when(
        F.col("_shaped"), strip(F.variant_get("_v", "$.clarification_question", "string"))
    )
    out = computed_once(
        typed,
        {**{f"{r}_score": c for r, c in scores.items()}, "clarification_question": question},
    )
    valid = F.col("_shaped")
    for route in ROUTES:
        valid = valid & F.coalesce(F.col(f"{route}_score").between(0.0, 1.0), F.lit(False))
    asked = F.col("clarification_question")
    valid = valid & (asked.isNull() | F.length(asked).between(1, MAX_GUIDANCE_CHARS))
    out = out.withColumn("valid", valid)
    return out.select(
        "request_id",
        *[F.when(F.col("valid"), F.col(f"{r}_score")).alias(f"{r}_score") for r in ROUTES],
        F.when(F.col("valid"), asked).alias("clarification_question"),
        "valid",
    )


def select_route(df: DataFrame, threshold: float = CONFIDENCE_THRESHOLD,
                 margin: float = AMBIGUITY_MARGIN, prefix: str = "",
                 suffix: str = "_score") -> DataFrame:
    """Add ``route, reason, guidance`` from the three score columns.

    Rows with a non-null ``degradation_reason`` (if that column exists) go to the knowledge base
    with reason ``classifier_fallback`` and have no candidates.
    """
    scores = {r: F.col(f"{prefix}{r}{suffix}") for r in ROUTES}
    decision = let(
        score_profile(scores),
        lambda p: decide(p["top"], p["gap"], p["top_route"], threshold, margin),
    )
    if "degradation_reason" in df.columns:
        fallback = F.struct(F.lit("knowledge_base").alias("route"),
                            F.lit("classifier_fallback").alias("reason"))
        decision = F.when(F.col("degradation_reason").isNotNull(), fallback).otherwise(decision)
    asked = (
        F.col("clarification_question") if "clarification_question" in df.columns
        else F.lit(None).cast("string")
    )
    return (
        df.withColumn("_d", decision)
        .withColumn("route", F.col("_d.route"))
        .withColumn("reason", F.col("_d.reason"))
        .withColumn(
            "guidance",
            F.when(F.col("route") == "clarification", F.coalesce(asked, F.lit(DEFAULT_GUIDANCE))),
        )
        .drop("_d")
    )


def apply_intents(requests: DataFrame, calls: DataFrame, parsed: DataFrame, **kw) -> DataFrame:
    """Classifier outcome per request: failed calls and bad answers fall back, others decide."""
    status = F.coalesce("call_status", F.lit("model_failure"))
    reason = (
        F.when(status == "timeout", INTENT_REASONS["timeout"])
        .when(status != "ok", INTENT_REASONS["model_failure"])
        .when(~F.coalesce("valid", F.lit(False)), INTENT_REASONS["protocol"])
    )
    joined = (
        requests.join(calls, "request_id", "left")
        .join(parsed, "request_id", "left")
        .withColumn("degradation_reason", reason)
        .drop("call_status", "valid")
    )
    return select_route(joined, **kw)


def bind_scope(decisions: DataFrame, routes: DataFrame) -> DataFrame:
    """Attach ``slugs`` configured for the chosen route.

    Of several rows for a route the smallest list counts, so at most one row per known route is
    sent to the tasks and no decision is multiplied.

    The slug lists are trimmed, lower-cased and deduplicated. A fallback decision carries no
    slugs, so it searches every compatible knowledge base.
    """
    slugs = F.array_distinct(F.transform("knowledge_base_slugs", lambda s: F.lower(strip(s))))
    tree = routes.where(F.col("route").isin(*ROUTES)).groupBy("route").agg(
        F.min(slugs).alias("_slugs"))
    return (
        decisions.join(F.broadcast(tree), "route", "left")
        .withColumn(
            "slugs",
            F.when(
                (F.col("reason") == "classifier_fallback") | F.col("_slugs").isNull(),
                F.array().cast("array<string>"),
            ).otherwise(F.col("_slugs")),
        )
        .drop("_slugs")
    )


def split_by_route(decisions: DataFrame) -> dict[str, DataFrame]:
    """The three branches as filters of one plan; only retrieval rows reach the vector search."""
    return {route: decisions.where(F.col("route") == route) for route in ROUTES}
