import pytest

from askgrid.operators import fusion, prompt, rerank
from conftest import rows

CANDIDATE = ("request_id long, query_index long, rank int, chunk_id string, document_id string, "
             "content_sha256 string, content string, similarity double")


def candidates(spark, *items):
    """Items are (query_index, rank, chunk, document, content, similarity) of request 1."""
    return spark.createDataFrame(
        [(1, q, r, c, d, f"h-{t}", t, s) for q, r, c, d, t, s in items], CANDIDATE)


def test_repeated_chunk_adds_its_terms_and_counts(spark):
    df = candidates(spark, (0, 1, "a", "d1", "x", 0.9), (0, 2, "b", "d2", "y", 0.8),
                    (1, 1, "c", "d3", "z", 0.7), (1, 2, "a", "d1", "x", 0.95))
    fused = fusion.rrf_fuse(df)
    got = {r["chunk_id"]: r for r in fused.collect()}
    assert got["a"]["rrf_score"] == 1 / 61 + 1 / 62
    assert (got["a"]["query_hit_count"], got["a"]["best_rank"], got["a"]["best_similarity"],
            got["a"]["first_query_index"]) == (2, 1, 0.95, 0)
    selected = fusion.select_candidates(fused)
    counts = fusion.fusion_counts(df, fused, selected).first()
    assert (counts["raw_candidates"], counts["unique_chunks"], counts["selected"]) == (4, 3, 3)


def test_representative_is_the_best_occurrence_not_the_first(spark):
    df = candidates(spark, (0, 5, "a", "d", "x", 0.9), (1, 2, "a", "d", "x", 0.8))
    assert fusion.rrf_fuse(df).first()["first_query_index"] == 1


def test_cap_does_not_bring_back_a_duplicate(spark):
    # c duplicates a's content in another document; a is capped away only after the dedup.
    df = candidates(spark, (0, 1, "p", "d1", "1", 0.9), (0, 2, "q", "d1", "2", 0.8),
                    (0, 3, "a", "d1", "same", 0.7), (0, 4, "c", "d2", "same", 0.6))
    assert rows(fusion.select_candidates(fusion.rrf_fuse(df)), "chunk_id") == [("p",), ("q",)]


def test_ties_follow_similarity_then_list_then_chunk_id(spark):
    df = candidates(spark, (0, 1, "b", "d1", "1", 0.9), (1, 1, "a", "d2", "2", 0.9),
                    (2, 1, "c", "d3", "3", 0.95))
    out = fusion.select_candidates(fusion.rrf_fuse(df)).orderBy("rank")
    assert [r["chunk_id"] for r in out.collect()] == ["c", "b", "a"]


def test_weights_and_limit(spark):
    df = candidates(spark, (0, 1, "a", "d1", "1", 0.9), (1, 1, "b", "d2", "2", 0.9))
    weights = spark.createDataFrame([(1, 0, 0.5), (1, 1, 2.0)],
                                    "request_id long, query_index long, weight double")
    out = fusion.select_candidates(fusion.rrf_fuse(df, weights), limit=1)
    assert [(r["chunk_id"], r["rank"]) for r in out.collect()] == [("b", 1)]


def reranked(spark, status, results, n=3, top_k=2):
    selected = spark.createDataFrame([(1, i + 1, f"c{i}") for i in range(n)],
                                     "request_id long, rank int, chunk_id string")
    sent = spark.createDataFrame(
        [(1, p, i, c, s) for p, (i, c, s) in enumerate(results, 1)],
        "request_id long, position int, original_index long, chunk_id string, score double")
    state = spark.createDataFrame([(1, status)], "request_id long, status string")
    out = rerank.apply_rerank(selected, sent, state, top_k).orderBy("rank").collect()
    return [r["chunk_id"] for r in out], out[0]["degradation_reason"]


GOOD = [(2, "c2", 0.9), (0, "c0", 0.4)]


@pytest.mark.parametrize("status,results,order,reason", [
    ("ok", GOOD, ["c2", "c0"], None),
    ("timeout", GOOD, ["c0", "c1"], "timeout"),
    ("disabled", [], ["c0", "c1"], "disabled"),
    ("ok", GOOD[:1], ["c0", "c1"], "protocol"),
    ("ok", [*GOOD, (1, "c1", 0.1)], ["c0", "c1"], "protocol"),
    ("ok", [(2, "c2", 0.9), (2, "c2", 0.4)], ["c0", "c1"], "protocol"),
    ("ok", [(2, "c2", 0.4), (0, "c0", 0.9)], ["c0", "c1"], "protocol"),
    ("ok", [(2, "c2", 1.4), (0, "c0", 0.9)], ["c0", "c1"], "protocol"),
    ("ok", [(7, "c2", 0.9), (0, "c0", 0.4)], ["c0", "c1"], "protocol"),
    ("ok", [(2, "other", 0.9), (0, "c0", 0.4)], ["c0", "c1"], "protocol"),
])
def test_rerank_is_applied_only_if_wholly_valid(spark, status, results, order, reason):
    assert reranked(spark, status, results) == (order, reason)


def test_scorer_orders_by_score_then_position(spark):
    df = spark.createDataFrame([(1, 0, "a b", "x"), (1, 1, "a b", "b"), (1, 2, "a b", "A"),
                                (1, 3, "", "a")],
                               "request_id long, original_index long, query string, passage string")
    out = rerank.score_pairs(df, top_n=3).orderBy("position")
    assert [(r["original_index"], r["score"]) for r in out.collect()] == [
        (1, 0.5), (2, 0.5), (0, 0.0)]


def test_prompt_text(spark):
    context = spark.createDataFrame(
        [(1, 1, "a & b", "A \"q\"", "k", "S > T", 3), (1, 2, "<x>", "B", "k'", None, None)],
        "request_id long, citation_number int, content string, display_name string, "
        "source_key string, section string, page_number int")
    requests = spark.createDataFrame([(1, " why? "), (2, "none")],
                                     "request_id long, question string")
    memory = spark.createDataFrame(
        [(1, "so <far>", [(1, "user", "hi"), (2, "assistant", "yo & yo")])],
        "request_id long, summary string, "
        "messages array<struct<ordinal:bigint,role:string,content:string>>")
    out = prompt.build_prompts(context, requests, memory).collect()
    assert len(out) == 1 and out[0]["n_sources"] == 2
    assert out[0]["user_prompt"] == (
        "<conversation_memory>\n<summary>\nso &lt;far&gt;\n</summary>\n"
        '<message role="user">hi</message>\n<message role="assistant">yo &amp; yo</message>\n'
        "</conversation_memory>\n<knowledge_context>\n"
        '<source id="1" document="A &quot;q&quot;" source_key="k" section="S &gt; T" page="3">\n'
        "a &amp; b\n</source>\n"
        '<source id="2" document="B" source_key="k&#x27;">\n&lt;x&gt;\n</source>\n'
        "</knowledge_context>\n<question>\nwhy?\n</question>")
