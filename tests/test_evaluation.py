import pytest
from pyspark.sql import functions as F

from askgrid.operators import gates, intent_eval, integrity, retrieval_eval as rv, scope, versions
from conftest import rows


def test_chunks_are_cut_before_documents_are_ranked(spark):
    data = [(1, r, "a") for r in range(1, 11)] + [(1, 11, "b")]
    df = spark.createDataFrame(data, "query_id long, rank int, document_id string")
    assert rows(rv.rank_documents(df)) == [(1, "a", 1)]
    assert rows(rv.rank_documents(df, top_k=11)) == [(1, "a", 1), (1, "b", 2)]


def test_metrics_keep_failures_in_the_denominator(spark):
    df = spark.createDataFrame(
        [(1, ["a", "x"], ["a"]), (2, ["x", "y", "b"], ["b", "c"]), (3, None, ["d"])],
        "query_id long, document_ids array<string>, required_document_ids array<string>")
    m = rv.retrieval_metrics(df).first()
    assert m["hit_at_1"] == pytest.approx(1 / 3) and m["hit_at_3"] == pytest.approx(2 / 3)
    assert m["recall_at_3"] == pytest.approx((1 + 0.5) / 3)
    assert m["mrr_at_10"] == pytest.approx((1 + 1 / 3) / 3)
    judged = rv.judge_cases(df)
    assert rows(judged, "query_id", "first_relevant_rank", "missing_document_ids") == [
        (1, 1, []), (2, 3, ["c"]), (3, None, ["d"])]


def test_wins_ties_losses_null_rules(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (None, 3), (3, None), (None, None)],
                               "off_rank int, on_rank int")
    assert tuple(rv.win_tie_loss(df).first()) == (2, 2, 2)
    assert tuple(rv.win_tie_loss(df, failed_on_loses=True).first()) == (2, 1, 3)


def test_degraded_intents_are_never_correct(spark):
    samples = spark.createDataFrame([(1, "S", True), (2, "C", False)],
                                    "query_id long, intent_l1 string, requires_rag boolean")
    decided = spark.createDataFrame(
        [(1, "knowledge_base", "classifier_fallback", "timeout"),
         (2, "system_direct", "high_confidence", None)],
        "query_id long, route string, reason string, degradation_reason string")
    cases = intent_eval.judge_intents(samples, decided)
    assert rows(cases, "query_id", "correct") == [(1, False), (2, True)]
    accuracy = {r["slice"]: r["accuracy"] for r in intent_eval.intent_accuracy(cases).collect()}
    assert accuracy == {"overall": 0.5, "rag": 0.0, "no_rag": 1.0, "intent_l1=S": 0.0,
                        "intent_l1=C": 1.0}
    assert intent_eval.confusion(cases).count() == 9


CASE = ("candidate string, query_id long, expected_route string, actual_route string, "
        "correct boolean")


def stage_cases(name, wrong=(), skip=()):
    out = []
    for i in range(20):
        expected = "knowledge_base" if i % 2 == 0 else "system_direct"
        actual = "clarification" if i in wrong else expected
        if i not in skip:
            out.append((name, i, expected, actual, i not in wrong))
    return out


RULES = (("f", "failure", "correct", "gte", 4), ("g", "guard", "correct", "eq", 5),
         ("all", "full", "correct", "gt", 17))


def test_gates_unlock_in_order_and_need_all_cases(spark):
    members = spark.createDataFrame(
        [(i, "failure") for i in range(5)] + [(i, "guard") for i in range(5, 10)],
        "query_id long, subset string")
    samples = spark.range(20).withColumnRenamed("id", "query_id")
    cases = spark.createDataFrame(
        stage_cases("good") + stage_cases("guard_bad", wrong=(6,))
        + stage_cases("short", skip=(7,)) + stage_cases("full_bad", wrong=(11, 12, 13)), CASE)
    _, result = gates.evaluate_gates(cases, members, samples, RULES)
    got = {(r["candidate"], r["stage"]): (r["passed"], r["unlocked"], r["complete"])
           for r in result.collect()}
    assert [got["good", s] for s in gates.STAGES] == [(True, True, True)] * 3
    assert [got["guard_bad", s][:2] for s in gates.STAGES] == [
        (True, True), (False, True), (False, False)]
    assert [got["short", s] for s in gates.STAGES] == [
        (True, True, True), (False, True, False), (False, False, False)]
    assert [got["full_bad", s][:2] for s in gates.STAGES] == [
        (True, True), (True, True), (False, True)]


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 3)], "b long, a string, c long")
    first = rows(gates.fingerprint(a, ["b", "a", "c"]), "fingerprint")
    assert first == rows(gates.fingerprint(a.select("c", "a", "b"), ["c", "a", "b"]), "fingerprint")
    same = gates.table_fingerprint(a.orderBy(F.col("b").desc()), ["a", "b"]).first()
    assert same == gates.table_fingerprint(a.repartition(3), ["b", "a"]).first()
    assert same != gates.table_fingerprint(a.where("b = 1"), ["b", "a"]).first()


def test_scope_normalisation_and_violations(spark):
    df = spark.createDataFrame(
        [(1, [2, 1, 2], [" s ", "s"], [1]), (2, list(range(101)), [""], [0]), (3, None, None, None)],
        "request_id long, scope_knowledge_base_id array<int>, scope_section array<string>, "
        "scope_page_number array<int>")
    out = {r["request_id"]: r for r in scope.normalize_scope(df).collect()}
    assert out[1]["scope_knowledge_base_id"] == [2, 1] and out[1]["scope_section"] == ["s"]
    assert out[1]["violations"] == [] and out[3]["scope_page_number"] == []
    assert sorted(out[2]["violations"]) == ["knowledge_base_id_count", "page_number_value",
                                            "section_value"]


def test_literal_scope_reaches_the_file_scan(spark, tmp_path):
    path = str(tmp_path / "chunks")
    spark.range(10).selectExpr("id as chunk_id", "cast(id % 3 as int) as page_number",
                               "'s' as section").write.parquet(path)
    df = spark.read.parquet(path).where(scope.scope_predicate(page_number=[1], section=[]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(page_number), EqualTo(page_number,1)]" in plan
    assert df.count() == 3


def test_failed_attempts_use_numbers_and_keep_the_active_version(spark):
    before = spark.createDataFrame([], "document_id string, knowledge_base_id string, "
                                   "version_number long, version_id string, "
                                   "content_sha256 string, status string, error_code string")
    batch = spark.createDataFrame(
        [("k", "a", s, f"f{s}", f"h{s}", ok, "embedding_timeout")
         for s, ok in ((1, True), (2, False), (3, True), (4, False))],
        "knowledge_base_id string, source_key string, attempt_seq long, filename string, "
        "content_sha256 string, ok boolean, error_code string")
    numbered = versions.assign_versions(before, batch)
    out = versions.apply_attempts(before, numbered, hot_rows=2)
    assert rows(out, "version_number", "status", "error_code") == [
        (1, "superseded", None), (2, "failed", "embedding_timeout"), (3, "active", None),
        (4, "failed", "embedding_timeout")]
    docs = versions.upsert_documents(
        spark.createDataFrame([], "document_id string, knowledge_base_id string, "
                              "source_key string, display_name string"), batch)
    assert rows(docs, "display_name") == [("f4",)]


def test_references_ignore_nulls_and_report_counts(spark):
    child = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 1)], "a int, b int")
    parent = spark.createDataFrame([(2, 1)], "x int, y int")
    assert rows(integrity.check_fk(child, parent, {"a": "x", "b": "y"})) == [(1, 1, 2)]


def test_whole_evaluation_runs(spark):
    from askgrid.plans.evaluate import evaluate_intents, evaluate_retrieval

    gold = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])],
                                 "query_id long, required_document_ids array<string>")
    ranked = "query_id long, rank int, document_id string"
    off = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (2, 1, "b")], ranked)
    on = spark.createDataFrame([(1, 1, "a"), (2, 1, "x"), (2, 2, "b")], ranked)
    run = evaluate_retrieval(gold, off, on)
    assert rows(run.metrics, "ranking", "cases") == [("off", 3), ("on", 3)]
    assert tuple(run.comparison.first()) == (1, 1, 1)
    assert evaluate_retrieval(gold, off).comparison is None
    samples = spark.createDataFrame(
        [(i, "S" if i % 2 else "C", f"l{i % 3}", i % 2 == 1) for i in range(30)],
        "query_id long, intent_l1 string, intent_l2 string, requires_rag boolean")
    decided = spark.createDataFrame(
        [(i, "knowledge_base", "high_confidence", None, 0.05, 0.9, 0.05) for i in range(30)],
        "query_id long, route string, reason string, degradation_reason string, "
        "system_direct_score double, knowledge_base_score double, clarification_score double")
    report = evaluate_intents(samples, decided, grid=[(0.75, 0.1), (0.95, 0.1)])
    assert rows(report.replay, "threshold", "correct_count", "to_clarification") == [
        (0.75, 15, 0), (0.95, 0, 30)]
    assert tuple(report.errors.first()) == (15, 0, 0)
    assert report.buckets.count() == 3 and report.confusion.count() == 9


def test_knowledge_bases_conflict_on_used_and_repeated_slugs(spark):
    from askgrid.operators.knowledge_bases import create_knowledge_bases

    drafts = spark.createDataFrame(
        [(1, " New-KB ", "a", None), (2, "new-kb", "b", " "), (3, "old", "c", None),
         (4, "-x", "d", None), (5, "ok", " ", None), (6, "ok", "e", "x" * 2001), (7, "ok", "f", " y ")],
        "draft_seq long, slug string, name string, description string")
    existing = spark.createDataFrame([("old",)], "slug string")
    for hot in (1, 100):
        made, bad = create_knowledge_bases(existing, drafts, scope.IndexConfig("m", "1", 8), hot)
        assert rows(made, "slug", "name", "description") == [("new-kb", "a", None), ("ok", "f", "y")]
        assert rows(bad, "draft_seq", "reject_code") == [
            (2, "knowledge_base_conflict"), (3, "knowledge_base_conflict"), (4, "slug_invalid"),
            (5, "name_invalid"), (6, "description_invalid")]
