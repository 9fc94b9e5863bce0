"""Staged evaluation: stage membership, gates, caches, drift checks, fingerprints, reports.

Stages are cumulative: ``failures`` is inside ``guard`` is inside ``full``. Membership is a
table ``members(query_id, subset)`` with ``failure`` and ``guard`` rows; ``full`` is everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.functions.text import squeeze_case
from askgrid.operators.intent_eval import (
    CLARIFY, DIRECT, KNOWLEDGE, expected_route, over_retrieval, under_retrieval,
)
from askgrid.plans.skew import HOT_ROWS, attach_per_key

STAGES = ("failures", "guard", "full")
SUBSET_STAGE = {"failure": 1, "guard": 2, "full": 3}
# The registered checks as (name, subset, metric, comparison, required).
STAGE_RULES = (
    ("failure_rag_correct", "failure", "rag_correct", "gte", 8),
    ("failure_no_rag_correct", "failure", "no_rag_correct", "gte", 8),
    ("failure_under_retrieval", "failure", "under_retrieval", "eq", 0),
    ("guard_correct", "guard", "correct", "gte", 17),
    ("guard_under_retrieval", "guard", "under_retrieval", "eq", 0),
    ("full_overall_correct", "full", "correct", "gt", 128),
    ("full_rag_correct", "full", "rag_correct", "gte", 121),
    ("full_no_rag_correct", "full", "no_rag_correct", "gt", 7),
    ("full_under_retrieval", "full", "under_retrieval", "eq", 0),
)
METRICS = ("correct", "rag_correct", "no_rag_correct", "under_retrieval", "over_retrieval",
           "clarification")


def _metrics() -> list[Column]:
    rag = F.col("expected_route") == KNOWLEDGE
    return [
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if("correct").alias("correct"),
        F.count_if(F.col("correct") & rag).alias("rag_correct"),
        F.count_if(F.col("correct") & ~rag).alias("no_rag_correct"),
        F.count_if(under_retrieval()).alias("under_retrieval"),
        F.count_if(over_retrieval()).alias("over_retrieval"),
        F.count_if(F.col("actual_route") == CLARIFY).alias("clarification"),
    ]


def _holds(actual: Column, comparison: Column, required: Column) -> Column:
    return (
        F.when(comparison == "eq", actual == required)
        .when(comparison == "gte", actual >= required)
        .when(comparison == "gt", actual > required)
    )


def subset_metrics(cases: DataFrame, members: DataFrame) -> DataFrame:
    """Counts per (candidate, subset), where every case is also in subset ``full``."""
    marked = (
        cases.join(members.select("query_id", "subset"), "query_id", "left")
        .withColumn("subset", F.explode(F.array_compact(
            F.array(F.col("subset"), F.lit("full")))))
    )
    return marked.groupBy("candidate", "subset").agg(*_metrics())


def evaluate_gates(cases: DataFrame, members: DataFrame, samples: DataFrame,
                   rules: Sequence[tuple] = STAGE_RULES) -> tuple[DataFrame, DataFrame]:
    """``(checks, gates)``: each check of each stage, and per (candidate, stage) its result.

    ``cases``: ``candidate, query_id, expected_route, actual_route, correct``. A stage checks
    the rules of its own and all earlier subsets; ``unlocked`` tells whether every earlier
    stage passed. A stage lacking cases of its members is ``complete = false`` and not passed.
    The rules are a literal of fixed size.
    """
    table = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(s).alias("subset"), F.lit(m).alias("metric"),
                 F.lit(c).alias("comparison"), F.lit(r).cast("bigint").alias("required"))
        for n, s, m, c, r in rules
    ])
    found = subset_metrics(cases, members)
    subsets = F.array(*[F.lit(s) for s in SUBSET_STAGE])
    metrics = (
        found.select("candidate").distinct()
        .withColumn("subset", F.explode(subsets))
        .join(found, ["candidate", "subset"], "left")
        .fillna(0, ["sample_count", *METRICS])
    )
    values = F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])
    own = F.filter(table, lambda rule: rule["subset"] == F.col("subset"))
    judged = (
        metrics.withColumn("_values", values)
        .select("candidate", "subset", "_values", F.explode(own).alias("_r"))
        .select(
            "candidate",
            "subset",
            F.col("_r.name").alias("name"),
            F.col("_r.comparison").alias("comparison"),
            F.col("_values")[F.col("_r.metric")].alias("actual"),
            F.col("_r.required").alias("required"),
        )
        .withColumn("passed", _holds(F.col("actual"), F.col("comparison"), F.col("required")))
    )
    order = F.create_map(*[F.lit(x) for pair in SUBSET_STAGE.items() for x in pair])
    first = order[F.col("subset")]
    stages = F.transform(
        F.sequence(first, F.lit(3)),
        lambda i: F.struct(i.alias("stage_no"),
                           F.element_at(F.array(*[F.lit(s) for s in STAGES]), i).alias("stage")),
    )
    checks = judged.withColumn("_s", F.explode(stages)).select(
        "candidate", "_s.stage_no", "_s.stage", "name", "comparison", "actual", "required",
        "passed",
    )
    sizes = members.select("subset").unionByName(
        samples.select(F.lit("full").alias("subset"))
    ).groupBy("subset").agg(F.count(F.lit(1)).alias("_want"))
    short = (
        metrics.join(sizes, "subset", "left")
        .where(F.col("sample_count") < F.col("_want"))
        .groupBy("candidate")
        .agg(F.min(first).alias("_short_from"))
    )
    before = Window.partitionBy("candidate").orderBy("stage_no").rowsBetween(
        Window.unboundedPreceding, -1)
    gates = (
        checks.groupBy("candidate", "stage_no", "stage")
        .agg(F.count(F.lit(1)).alias("n_checks"), F.bool_and("passed").alias("_passed"))
        .join(short, "candidate", "left")
        .withColumn("complete", F.col("_short_from").isNull()
                    | (F.col("stage_no") < F.col("_short_from")))
        .withColumn("passed", F.col("_passed") & F.col("complete"))
        .withColumn("unlocked", F.coalesce(F.bool_and("passed").over(before), F.lit(True)))
        .drop("_passed", "_short_from")
    )
    return checks, gates


def zero_error_gate(cases: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Gate of a frozen challenge: all routes right and no over-, under-retrieval or question."""
    counts = cases.groupBy(*by).agg(*_metrics())
    checks = F.array(
        F.struct(F.lit("all_routes_correct").alias("name"), F.col("correct").alias("actual"),
                 F.col("sample_count").alias("required")),
        *[F.struct(F.lit(m).alias("name"), F.col(m).alias("actual"),
                   F.lit(0).cast("bigint").alias("required"))
          for m in ("under_retrieval", "over_retrieval", "clarification")],
    )
    return counts.select(*by, F.explode(checks).alias("c")).select(*by, "c.*").withColumn(
        "passed", F.col("actual") == F.col("required")
    )


def check_manifest(members: DataFrame, samples: DataFrame, baseline: DataFrame,
                   strata: DataFrame | None = None) -> DataFrame:
    """``(code, detail, n)`` where stage membership no longer fits the baseline.

    The failure subset must equal the baseline's wrong cases, guards must have been correct, and
    counts per ``(subset, dimension, value)`` must equal ``strata`` if given.
    """
    failures = members.where("subset = 'failure'").select("query_id")
    wrong = baseline.where(~F.col("correct")).select("query_id")

    def counted(df: DataFrame, code: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(code).alias("code"), F.lit("").alias("detail"), "n"
        ).where("n > 0")

    guards = members.where("subset = 'guard'").select("query_id")
    out = (
        counted(failures.exceptAll(wrong), "failure_not_wrong_in_baseline")
        .unionByName(counted(wrong.exceptAll(failures), "wrong_case_not_listed"))
        .unionByName(counted(guards.join(wrong, "query_id", "left_semi"), "guard_was_wrong"))
        .unionByName(counted(
            members.select("query_id").join(baseline.select("query_id"), "query_id", "left_anti"),
            "unknown_query_id"))
    )
    if strata is None:
        return out
    known = samples.select("query_id", "intent_l1",
                           expected_route(F.col("requires_rag")).alias("route"))
    actual = (
        members.join(known, "query_id")
        .select("subset", F.explode(F.create_map(
            F.lit("intent_l1"), "intent_l1", F.lit("route"), "route")).alias("dimension", "value"))
        .groupBy("subset", "dimension", "value").agg(F.count(F.lit(1)).alias("_n"))
    )
    keys = ["subset", "dimension", "value"]
    drift = actual.join(strata.select(*keys, F.col("n").alias("_want")), keys, "full_outer").where(
        ~F.coalesce("_n", F.lit(0)).eqNullSafe(F.coalesce("_want", F.lit(0)))
    )
    return out.unionByName(drift.select(
        F.lit("strata_drift").alias("code"), F.concat_ws("/", *keys).alias("detail"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n")))


def stage_members(stage: str, members: DataFrame, samples: DataFrame) -> DataFrame:
    """Query ids a cumulative stage must cover."""
    if stage == "full":
        return samples.select("query_id")
    subsets = ["failure"] if stage == "failures" else ["failure", "guard"]
    return members.where(F.col("subset").isin(*subsets)).select("query_id")


def pending_cases(target: DataFrame, cache: DataFrame) -> DataFrame:
    """Target ids without a cached success."""
    return target.join(
        cache.where(F.col("degradation_reason").isNull()).select("query_id"),
        "query_id", "left_anti",
    )


def check_cache(cache: DataFrame, samples: DataFrame, scores: Sequence[str],
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(query_id, code)`` for cached cases that must not be reused.

    The labels of a case are joined back with repeated ids spread; the same counts give the
    repeats.
    """
    key = ["query_id"]
    counts = cache.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    truth = samples.select(
        *key, F.col("intent_l1").alias("_l1"),
        expected_route(F.col("requires_rag")).alias("_route"), F.lit(True).alias("_known"),
    )
    joined = attach_per_key(cache, counts.join(truth, key, "left"), key, "_rows", hot_rows)
    no_scores = F.lit(False)
    for column in scores:
        no_scores = no_scores | F.col(column).isNull()
    known = F.col("_known").isNotNull()
    rules = {
        "unknown_query_id": ~known,
        "intent_changed": known & ~F.col("intent_l1").eqNullSafe(F.col("_l1")),
        "expected_route_changed": known & ~F.col("expected_route").eqNullSafe(F.col("_route")),
        "not_a_success": F.col("degradation_reason").isNotNull(),
        "scores_missing": no_scores,
    }
    codes = F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()])
    rows = joined.select(
        *key, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code")
    )
    repeated = counts.where(F.col("_rows") > 1).select(
        *key, F.lit("query_id_repeated").alias("code"))
    return rows.unionByName(repeated)


def fingerprint(df: DataFrame, cols: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """Add the SHA-256 of the row as JSON with sorted keys and nulls kept."""
    packed = F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})
    return df.withColumn(name, F.sha2(packed, 256))


def table_fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Order-free identity of a table in one row: count, xor and sum of row hashes.

    A row's hash is the first 60 bits of its SHA-256 (``fingerprint``), so any other engine can
    follow.
    """
    hashed = fingerprint(df.select(*cols), cols, "_sha")
    row = F.conv(F.substring("_sha", 1, 15), 16, 10).cast("bigint")
    return hashed.select(row.alias("_h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("_h").alias("hash_xor"),
        F.sum(F.col("_h").cast("decimal(38,0)")).alias("hash_sum"),
    )


def check_challenge(challenge: DataFrame, base: DataFrame) -> DataFrame:
    """``(code, n)``: repeated or reused ids and questions, compared without case and spaces.

    ``reused`` counts challenge rows also in ``base``; ``repeated`` counts surplus rows.
    """
    norm = squeeze_case(F.col("query"))
    mine = challenge.select("query_id", norm.alias("_q"))
    ids = mine.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    texts = mine.groupBy("_q").agg(F.count(F.lit(1)).alias("_n"))

    def surplus(groups: DataFrame, code: str) -> DataFrame:
        return groups.where("_n > 1").agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")
        ).select(F.lit(code).alias("code"), "n")

    def reused(groups: DataFrame, other: DataFrame, key: str, code: str) -> DataFrame:
        return groups.join(other, key, "left_semi").agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n")
        ).select(F.lit(code).alias("code"), "n")

    theirs = base.select("query_id", norm.alias("_q"))
    return (
        surplus(ids, "query_id_repeated")
        .unionByName(surplus(texts, "question_repeated"))
        .unionByName(reused(ids, theirs.select("query_id").distinct(), "query_id",
                            "query_id_reused"))
        .unionByName(reused(texts, theirs.select("_q").distinct(), "_q", "question_reused"))
    )


def challenge_balance(challenge: DataFrame) -> DataFrame:
    """Counts per expected route, and how many contradict the retrieval boundary of their l1."""
    crossed = (F.col("expected_route") == KNOWLEDGE) != (F.col("intent_l1") == "SUPPORT")
    return challenge.groupBy("expected_route").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(crossed).alias("boundary_errors")
    )


def stage_report(target: DataFrame, samples: DataFrame, cache: DataFrame, reused_before: DataFrame,
                 failed_attempts: DataFrame) -> DataFrame:
    """One row per stage run: target, reused and new cases, attempts, remaining, tokens, errors.

    ``cache``: all cached successes; ``reused_before``: ids cached before this run;
    ``failed_attempts``: one row per failed call.
    """
    cases = cache.join(target, "query_id", "left_semi")
    rag = F.col("expected_route") == KNOWLEDGE
    counts = cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("correct").alias("correct"),
        F.count_if(rag).alias("rag_cases"),
        F.count_if(rag & F.col("correct")).alias("rag_correct"),
        F.count_if(F.col("expected_route") == DIRECT).alias("no_rag_cases"),
        F.count_if((F.col("expected_route") == DIRECT) & F.col("correct")).alias("no_rag_correct"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.count_if(under_retrieval()).alias("under_retrieval"),
        F.count_if(over_retrieval()).alias("over_retrieval"),
        F.count_if(F.col("actual_route") == CLARIFY).alias("clarification"),
    )

    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    reused = target.join(reused_before.select("query_id"), "query_id", "left_semi")
    return (
        counts.withColumn("target", size(target))
        .withColumn("reused", size(reused))
        .withColumn("total_cached", size(cache))
        .withColumn("failed_attempts", size(failed_attempts))
        .withColumn("samples", size(samples))
        .withColumn("new_calls", F.col("target") - F.col("reused"))
        .withColumn("total_attempts", F.col("total_cached") + F.col("failed_attempts"))
        .withColumn("remaining", F.col("samples") - F.col("total_cached"))
        .withColumn("complete", F.col("cases") == F.col("target"))
        .withColumn("accuracy", F.col("correct") / F.nullif(F.col("cases"), F.lit(0)))
        .drop("samples")
    )
