"""Search on product-quantised codes: recall, exactness under filters, stored form, effort."""

import numpy as np
import pytest

from askgrid.operators import ivf, ivfpq
from askgrid.operators.vector_topk import scope_column, topk_cosine
from tests.conftest import rows as all_rows
from tests.test_vector_topk import peak_mb

K = 10


def rows(df):
    """Scores are compared at ten decimals: products may differ in the last one."""
    if "similarity" in df.columns:
        df = df.selectExpr("query_id", "rank", "chunk_id", "round(similarity, 10) as similarity")
    return all_rows(df)


DIM = 24


def frames(spark, vectors, queries):
    c = spark.createDataFrame(
        [(i, v.tolist(), i // 20, i % 3, f"s{i % 4}") for i, v in enumerate(vectors)],
        "chunk_id long, embedding array<float>, document_id long, knowledge_base_id int, "
        "section string")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)],
                              "query_id long, query_vector array<double>")
    return c, q


@pytest.fixture(scope="module", params=["noise", "clusters"])
def built(request, spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, DIM))
    if request.param == "clusters":  # one cluster holds a third of all rows
        owner = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 40, 3000))
        vectors = rng.normal(size=(40, DIM))[owner] * 2 + vectors * 0.3
    c, q = frames(spark, vectors, vectors[::100] + rng.normal(size=(30, DIM)) * 0.1)
    index = ivfpq.tune(q, ivfpq.build_pq(c, groups=8), K, 0.9)
    return request.param, c, q, index


def recall_of(found, exact):
    return ivf.ann_recall(found, exact, K).selectExpr("sum(hits) / sum(expected)").first()[0]


def test_recall_and_effort(built):
    kind, c, q, index = built
    assert index.n_lists > 40 and index.sizes.sum() == 3000
    found = ivfpq.topk_pq(q, index, K)
    assert recall_of(found, topk_cosine(q, c, K)) >= 0.9
    assert rows(found) == rows(ivfpq.topk_pq(q, index, K, slab_rows=7))
    read = ivfpq.effort(q, index).collect()
    assert len(read) == 30 and all(r.vectors_read * 4 <= r.chunks for r in read)
    if kind == "clusters":
        assert index.share < 0.6


def test_all_lists_and_full_depth_are_exact(built):
    _, c, q, index = built
    assert rows(ivfpq.topk_pq(q, index, K, share=1.0, depth=3000)) == rows(topk_cosine(q, c, K))


def test_filters_of_any_strictness(built):
    _, c, q, index = built
    for scope in (
            ["array(query_id) as scope_document_id"],  # twenty chunks, all scored
            ["array(query_id, query_id + 1) as scope_document_id", "array('s1') as scope_section"],
            ["array(4) as scope_document_id", "array('none') as scope_section"],
            ["array(1) as scope_knowledge_base_id", "cast(null as array<string>) as scope_section"]):
        wanted = q.selectExpr("*", *scope)
        exact = topk_cosine(wanted, c, K)
        found = ivfpq.topk_pq(wanted, index, K, depth=40)
        if "document" in scope[0]:
            assert rows(found) == rows(exact)
        else:
            assert recall_of(found, exact) >= 0.85
            assert found.count() == exact.count()
    probed = ivfpq.probe(q.selectExpr("*", "array(query_id) as scope_document_id"), index, 1.0, 0)
    true = c.join(index.codes.select("chunk_id", "list_id"), "chunk_id").selectExpr(
        "document_id as query_id", "list_id").distinct()
    # Only lists with a match are read.
    assert rows(probed.select("query_id", "list_id")) == rows(true.where("query_id < 30"))


def test_starved_queries_search_the_rest_of_their_lists(built):
    """Two attributes whose values lie in the same lists but seldom in the same chunk."""
    _, c, q, index = built
    wanted = q.selectExpr("*", "array(1) as scope_knowledge_base_id",
                          "array(5, 60, 111) as scope_document_id", "array('s2') as scope_section")
    assert scope_column("section") in wanted.columns
    exact = topk_cosine(wanted, c, K)
    assert rows(ivfpq.topk_pq(wanted, index, K, share=0.01, depth=K)) == rows(exact)


def test_stored_index_and_damaged_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    c, q = frames(spark, rng.normal(size=(200, DIM)), rng.normal(size=(5, DIM)))
    bad = spark.createDataFrame(
        [(900, None, 1, 1, "s1"), (901, [1.0], 1, 1, "s1"), (902, [0.0] * DIM, 1, 1, "s1"),
         (903, [float("nan")] * DIM, 1, 1, None)], c.schema)
    index = ivfpq.build_pq(c.unionByName(bad), n_lists=4)
    ivfpq.write_pq(index, str(tmp_path / "index"))
    stored = ivfpq.read_pq(spark, str(tmp_path / "index"))
    assert stored.sizes.tolist() == index.sizes.tolist() and stored.sizes.sum() == 200
    assert np.allclose(stored.codebooks, index.codebooks)
    asked = q.unionByName(spark.createDataFrame([(77, [1.0]), (78, None)], q.schema))
    assert rows(ivfpq.topk_pq(asked, stored, K, 1.0, 200)) == rows(topk_cosine(q, c, K))
    assert ivfpq.topk_pq(q.limit(0), stored, K).count() == 0
    assert ivfpq.tune(q.limit(0), stored).share == 1.0
    assert ivfpq.topk_pq(q, ivfpq.build_pq(c.limit(0)), K).count() == 0


def test_codes_stand_for_their_vectors():
    rng = np.random.default_rng(0)
    centroids, books = rng.normal(size=(3, 10)), rng.normal(size=(256, 10))
    lists = np.array([0, 2, 1])
    made = np.stack([ivfpq.decode(rng.integers(0, 256, (1, 4)).astype(np.uint8), centroids[i],
                                  books)[0] for i in lists])
    codes = ivfpq.encode(made, lists, centroids, books, 4)
    again = np.stack([ivfpq.decode(codes[[i]], centroids[lists[i]], books)[0] for i in range(3)])
    assert np.allclose(again, made)


def test_nearest_ids_order_ties_by_id():
    unit = np.eye(4)[[0, 1, 0, 2, 0]]
    got = ivf.nearest_ids(np.array([[1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]]), unit, 3)
    assert got.tolist() == [[0, 2, 4], [0, 1, 2]]


def test_training_and_encoding_hold_few_scores():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(40_000, 4))
    # All scores of a round are 82 MB.
    assert peak_mb(lambda: ivfpq._lloyd(points, 256, 1, 3)) < 25
    book = rng.normal(size=(256, 4))
    want = ((points[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
    assert np.array_equal(ivfpq._nearest_words(points, book), want)


def test_every_query_probes_every_filled_list_at_full_share(built):
    _, _, q, index = built
    sizes = ivfpq.probe(q, index, 1.0, 0).groupBy("query_id").count()
    assert {r["count"] for r in sizes.collect()} == {int((index.sizes > 0).sum())}
