import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from askgrid.operators import ivf
from askgrid.operators.vector_topk import _Batch, _TopK, cell_topk, scope_column, topk_cosine
from askgrid.workload import retrieval

K = 7


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    chunks = rng.normal(size=(300, 12))
    chunks[100:140] = chunks[99]  # a group of copies
    queries = np.vstack([rng.normal(size=(9, 12)), chunks[99:100]])
    c = spark.createDataFrame(
        [(i, v.tolist(), i % 5, f"s{i % 3}") for i, v in enumerate(chunks)],
        "chunk_id long, embedding array<float>, knowledge_base_id int, section string")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)],
                              "query_id long, query_vector array<double>")
    return c, q, chunks.astype(np.float32).astype(float), queries


def brute(chunks, queries, k, allowed=lambda q, c: True):
    unit = chunks / np.linalg.norm(chunks, axis=1, keepdims=True)
    out = []
    for qi, q in enumerate(queries):
        scores = np.round(unit @ (q / np.linalg.norm(q)), 12)
        order = sorted((i for i in range(len(chunks)) if allowed(qi, i)),
                       key=lambda i: (-scores[i], i))[:k]
        out += [(qi, rank, i) for rank, i in enumerate(order, 1)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect())


def test_scan_and_cells_equal_brute_force(vectors):
    c, q, cm, qm = vectors
    want = brute(cm, qm, K)
    assert found(topk_cosine(q, c, K)) == want
    assert found(topk_cosine(q, c, K, broadcast_bytes=0, slab_rows=37)) == want
    assert found(cell_topk(c, q, K, slab_rows=4)) == want


def test_filters_apply_before_ranking(spark, vectors):
    c, q, cm, qm = vectors
    kbs = {0: [1], 1: [1, 2], 2: []}
    scoped = q.join(spark.createDataFrame(
        [(i, kbs.get(i, []), ["s1"] if i == 2 else None) for i in range(len(qm))],
        f"query_id long, {scope_column('knowledge_base_id')} array<int>, "
        f"{scope_column('section')} array<string>"), "query_id")

    def allowed(qi, i):
        kb_ok = not kbs.get(qi) or i % 5 in kbs[qi]
        return kb_ok and (qi != 2 or i % 3 == 1)

    want = brute(cm, qm, K, allowed)
    assert found(topk_cosine(scoped, c, K)) == want
    assert found(topk_cosine(scoped, c, K, broadcast_bytes=0, slab_rows=50)) == want


def test_string_ids_zero_vectors_and_fewer_chunks_than_k(spark):
    c = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("z", [0.0, 0.0])],
                              "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, query_vector array<double>")
    got = [(r["rank"], r["chunk_id"], r["similarity"]) for r in
           topk_cosine(q, c, 5).orderBy("rank").collect()]
    assert got == [(1, "a", 1.0), (2, "b", 1.0)]


def test_ivf_with_all_lists_is_exact_and_split_lists_agree(vectors):
    c, q, cm, qm = vectors
    index = ivf.build_ivf(c, n_lists=6)
    assert found(ivf.topk_ivf(q, index, K, nprobe=6)) == brute(cm, qm, K)
    probed = ivf.probe_lists(q, index, 3)
    one = cell_topk(index.chunks, probed, K, bucket="list_id")
    many = cell_topk(index.chunks, probed, K, bucket="list_id", slab_rows=5)
    assert found(one) == found(many)
    exact = topk_cosine(q, c, K)
    recall = ivf.ann_recall(ivf.topk_ivf(q, index, K, nprobe=4), exact, K)
    assert recall.agg({"recall": "avg"}).first()[0] >= 0.7
    assert recall.count() == len(qm)


def test_probes_follow_the_wanted_recall(spark):
    rng = np.random.default_rng(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 12)))],
                              "query_id long, query_vector array<double>")
    few = None
    for size in (300, 3000):  # every 30th vector is a centroid: 10 lists, then 100
        vectors = rng.normal(size=(size, 12))
        c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)],
                                  "chunk_id long, embedding array<float>")
        exact, index = topk_cosine(q, c, K), ivf.assign_lists(c, vectors[::30])

        def recall(nprobe):
            found = ivf.topk_ivf(q, index, K, nprobe=nprobe, refill=False)
            return ivf.ann_recall(found, exact, K).agg({"recall": "avg"}).first()[0]

        nprobe = ivf.probes_for_recall(q, exact, index, 0.9)
        few = few or nprobe
        assert recall(nprobe) >= 0.9 > recall(nprobe - 1)
    assert nprobe > few and recall(few) < 0.9  # a fixed number loses neighbours as lists grow
    assert ivf.probes_for_recall(q, exact.limit(0), index, 0.9) == index.n_lists


def test_too_many_given_centroids_are_an_error(vectors, monkeypatch):
    c, _, cm, _ = vectors
    monkeypatch.setattr(ivf, "MAX_LISTS", 3)
    monkeypatch.setattr(retrieval.data, "chunks", lambda spark, d: c)
    with pytest.raises(ValueError, match="centroids"):
        retrieval._given_index(c.sparkSession, "")


def test_ivf_refills_starved_queries(spark, vectors):
    c, q, cm, qm = vectors
    index = ivf.build_ivf(c, n_lists=6)
    strict = q.selectExpr("*", f"array(3) as {scope_column('knowledge_base_id')}")
    want = brute(cm, qm, 60, lambda qi, i: i % 5 == 3)
    assert found(ivf.topk_ivf(strict, index, 60, nprobe=1)) == want
    short = ivf.topk_ivf(strict, index, 60, nprobe=1, refill=False)
    assert short.count() < len(want)


def test_stored_index_takes_new_chunks_and_given_centroids(spark, vectors, tmp_path):
    c, q, cm, qm = vectors
    index = ivf.assign_lists(c.where("chunk_id < 200"), cm[::40])
    ivf.write_ivf(index, str(tmp_path / "index"))
    stored = ivf.read_ivf(spark, str(tmp_path / "index"))
    assert np.allclose(stored.centroids, cm[::40])
    more = ivf.assign_lists(c.where("chunk_id >= 200"), stored.centroids)
    ivf.write_ivf(more, str(tmp_path / "index"), mode="append")
    stored = ivf.read_ivf(spark, str(tmp_path / "index"))
    assert stored.chunks.count() == 300
    assert found(ivf.topk_ivf(q, stored, K, nprobe=8)) == brute(cm, qm, K)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_damaged_vectors_are_listed_and_not_ranked(spark, limit):
    from askgrid.operators.vector_topk import vector_violations

    chunks = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
         (6, [None, 1.0]), (7, [0.5, 0.5])], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [2.0]), (3, None), (4, [0.0, 0.0])],
                                    "query_id long, query_vector array<double>")
    got = found(topk_cosine(queries, chunks, 5, broadcast_bytes=limit))
    assert got == [(1, 1, 1), (1, 2, 7), (2, 1, 2)]
    codes = {r["chunk_id"]: r["code"]
             for r in vector_violations(chunks, "chunk_id", "embedding", 2).collect()}
    assert codes == {2: "dimension_mismatch", 3: "vector_missing", 4: "zero_norm",
                     5: "not_finite", 6: "not_finite"}


def test_facts_are_the_same_by_broadcast_and_by_shuffle(spark, vectors):
    from askgrid.operators.vector_topk import attach_facts

    c, q, _, _ = vectors
    top = topk_cosine(q, c, K)
    facts = c.select("chunk_id", "section")
    small, large = attach_facts(top, facts), attach_facts(top, facts, rows=0)
    assert found(small) == found(large) == found(top)
    assert small.columns == large.columns


def peak_mb(work):
    """MB that ``work`` holds at most; numpy reports its arrays."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_scan_holds_few_scores_whatever_the_block_and_the_batch():
    rng = np.random.default_rng(5)
    rows, queries = rng.normal(size=(8192, 16)), rng.normal(size=(2500, 16))
    block = pa.table({"chunk_id": np.arange(8192), "embedding": rows.tolist()})
    batch = _Batch(pa.table({"query_id": np.arange(2500), "query_vector": queries.tolist()}), [])
    top = _TopK(batch, K)
    # All scores of the block are 164 MB.
    assert peak_mb(lambda: top.add(block)) < 50
    got = top.result(pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()),
                                ("similarity", pa.float64())]))
    want = [i for _, _, i in brute(rows, queries[:20], K)]
    assert got["chunk_id"].to_pylist()[:20 * K] == want
    # Lists of all rows: 60 MB of scores at once before.
    assert peak_mb(lambda: ivf.nearest_ids(rows, queries[:900], 1)) < 20
