"""Queries over vector retrieval, fusion, reranking and prompts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.operators import fusion, ivf, ivfpq, prompt, rerank, scope
from askgrid.operators.vector_topk import attach_facts, topk_cosine, vector_violations
from askgrid.plans.shared import written
from askgrid.workload import data
from askgrid.workload.data import CONFIG, Registry, table

R = Registry()
LIMIT = 25


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    queries = data.query_vectors(spark, d)
    top = topk_cosine(queries.select("query_id", "query_vector"), data.chunks(spark, d), k=20)
    facts = data.chunks(spark, d).drop("embedding")
    return attach_facts(
        top.withColumn("request_id", F.expr("query_id div 4"))
        .withColumn("query_index", F.col("query_id") % 4),
        facts,
    )


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return data.requests(spark, d).select(
        "request_id", F.posexplode("sub_questions").alias("query_index", "_q")
    ).select(
        "request_id",
        F.col("query_index").cast("bigint").alias("query_index"),
        (F.lit(1.0) / (1 + F.col("query_index"))).alias("weight"),
    )


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf_fuse(_candidates(spark, d), _weights(spark, d))


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return fusion.select_candidates(_fused(spark, d), limit=LIMIT)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Several question vectors per request to ten cited chunks per request."""
    context = prompt.select_context(_selected(spark, d), top_k=10)
    return context.select(
        "request_id", "citation_number", "chunk_id", "document_id",
        F.round("rrf_score", 6).alias("rrf_score"),
        F.round("best_similarity", 6).alias("similarity"),
    )


R.add("retrieve_fuse_cite", data.FUSED_SQL + """
select request_id, rank as citation_number, chunk_id, document_id,
  round(rrf_score, 6) as rrf_score, round(best_similarity, 6) as similarity
from selected where rank <= 10""")(flagship)

# --- scopes ---------------------------------------------------------------------------------

SCOPE_CLEAN_SQL = "with " + data.REQUESTS_SQL + """,
firsts as (
  select *, list_distinct(scope_knowledge_base_id) as kb,
    list_distinct(list_transform(scope_section, lambda s: trim(s))) as sections,
    list_distinct(scope_page_number) as pages from requests)
"""


@R.add("c1_normalize_scope", SCOPE_CLEAN_SQL + """
select request_id, array_to_string(list_sort(kb), ',') as kbs,
  array_to_string(list_sort(sections), ',') as sections,
  array_to_string(list_sort(pages), ',') as pages,
  case when list_contains(pages, 0) then 'page_number_value' else '' end as violations
from firsts""")
def _c1(spark, d):
    out = scope.normalize_scope(data.requests(spark, d))

    def text(c):
        return F.array_join(F.array_sort(F.col(c)).cast("array<string>"), ",")

    return out.select(
        "request_id", text("scope_knowledge_base_id").alias("kbs"),
        text("scope_section").alias("sections"), text("scope_page_number").alias("pages"),
        F.array_join("violations", ",").alias("violations"),
    )


SLUGS_SQL = """slugs as (
  select request_id, pos, 'kb-' || scope_knowledge_base_id[pos] as slug
  from (select *, unnest(range(1, len(scope_knowledge_base_id) + 1)) as pos from requests))"""


@R.add("c2_resolve_slugs", "with " + data.REQUESTS_SQL + ", " + data.KBS_SQL + ", " + SLUGS_SQL
       + """
select r.request_id,
  coalesce(string_agg(k.knowledge_base_id::varchar, ',' order by s.pos), '') as kbs,
  coalesce(string_agg(case when s.slug is not null and k.slug is null then s.slug end, ','
    order by s.pos), '') as unknown
from requests r left join slugs s using (request_id) left join kbs k on s.slug = k.slug
group by 1""")
def _c2(spark, d):
    asked = data.requests(spark, d).select(
        "request_id",
        F.transform("scope_knowledge_base_id",
                    lambda k: F.concat(F.lit("kb-"), k.cast("string"))).alias("slugs"),
    )
    out = scope.resolve_slugs(asked, data.knowledge_bases(spark, d))
    return out.select(
        "request_id",
        F.coalesce(F.array_join(F.col("knowledge_base_ids").cast("array<string>"), ","),
                   F.lit("")).alias("kbs"),
        F.coalesce(F.array_join("unknown_slugs", ","), F.lit("")).alias("unknown"),
    )


@R.add("c3_compatible_chunks", "with " + data.CHUNKS_SQL + """
select knowledge_base_id, count(*) as n_chunks from chunks
where knowledge_base_id <> 9 group by 1""")
def _c3(spark, d):
    kept = scope.compatible_chunks(data.chunks(spark, d), data.knowledge_bases(spark, d), CONFIG)
    return kept.groupBy("knowledge_base_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@R.add("c3_scope_violations", "with " + data.REQUESTS_SQL + ", " + data.KBS_SQL + """
select distinct r.request_id, r.knowledge_base_id,
  case when k.knowledge_base_id is null then 'knowledge_base_not_found'
    else 'index_configuration_mismatch' end as code
from (select request_id, unnest(scope_knowledge_base_id) as knowledge_base_id from requests) r
left join kbs k using (knowledge_base_id)
where k.knowledge_base_id is null or k.embedding_model_revision <> 'r1'""")
def _c3v(spark, d):
    return scope.scope_violations(data.requests(spark, d), data.knowledge_bases(spark, d), CONFIG)


SCOPED_SQL = "with " + data.CHUNKS_SQL + ", " + data.QUERIES_SQL + """,
scored as (
  select q.query_id, c.chunk_id,
    round(list_cosine_similarity(q.query_vector, c.embedding), 12) as similarity
  from queries q join requests r using (request_id) join chunks c on
    c.knowledge_base_id <> 9
    and (len(r.scope_knowledge_base_id) = 0
      or list_contains(r.scope_knowledge_base_id, c.knowledge_base_id))
    and (len(r.scope_document_id) = 0 or list_contains(r.scope_document_id, c.document_id))
    and (len(r.scope_document_format) = 0
      or list_contains(r.scope_document_format, c.document_format))
    and (len(r.scope_section) = 0
      or list_contains(list_transform(r.scope_section, lambda s: trim(s)), c.section))
    and (len(r.scope_page_number) = 0
      or list_contains(r.scope_page_number, c.page_number)))
select query_id, rank, chunk_id, round(similarity, 6) as similarity from (
  select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank
  from scored) where rank <= 20"""


@R.add("c4_scoped_topk", SCOPED_SQL)
def _c4(spark, d):
    scopes = scope.normalize_scope(data.requests(spark, d)).drop(
        "question", "sub_questions", "violations")
    queries = data.query_vectors(spark, d).join(scopes, "request_id")
    usable = scope.compatible_chunks(
        data.chunks(spark, d), data.knowledge_bases(spark, d), CONFIG)
    top = topk_cosine(queries, usable, k=20)
    return top.select("query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


@R.add("c5_topk_cosine", data.TOPK_SQL + """
select query_id, rank, chunk_id, round(1 - similarity, 6) as cosine_distance,
  round(similarity, 6) as similarity from candidates""")
def _c5(spark, d):
    queries = data.query_vectors(spark, d).select("query_id", "query_vector")
    top = topk_cosine(queries, data.chunks(spark, d), k=20)
    return top.select("query_id", "rank", "chunk_id",
                      F.round("cosine_distance", 6).alias("cosine_distance"),
                      F.round("similarity", 6).alias("similarity"))


# Every seventh vector is damaged in one of five ways, every third query in one of three.
DAMAGED_VECTORS_SQL = "with " + data.CHUNKS_SQL + ", " + data.QUERIES_SQL + """,
c as (
  select chunk_id, case when chunk_id % 35 = 0 then null when chunk_id % 35 = 7
      then embedding[1:63] when chunk_id % 35 = 14 then list_transform(embedding, lambda x: 0.0)
    when chunk_id % 35 = 21 then list_transform(embedding, lambda x, i:
      case when i = 5 then null else x end)
    when chunk_id % 35 = 28 then list_transform(embedding, lambda x, i:
      case when i = 9 then 'nan'::double else x end) else embedding end as v from chunks),
q as (
  select query_id, case when query_id % 9 = 0 then null when query_id % 9 = 3
      then query_vector[1:10] when query_id % 9 = 6
      then list_transform(query_vector, lambda x: 0.0) else query_vector end as v from queries),
bad as (
  select 'chunk' as side, chunk_id as id, case chunk_id % 35 when 0 then 'vector_missing'
    when 7 then 'dimension_mismatch' when 14 then 'zero_norm' else 'not_finite' end as code
  from c where chunk_id % 7 = 0
  union all
  select 'query', query_id, case query_id % 9 when 0 then 'vector_missing'
    when 3 then 'dimension_mismatch' else 'zero_norm' end from q where query_id % 3 = 0),
scored as (
  select query_id, chunk_id,
    round(list_cosine_similarity(q.query_vector, c.embedding), 12) as similarity
  from queries q, chunks c where query_id % 3 <> 0 and chunk_id % 7 <> 0)
select side, id, null::bigint as rank, null::bigint as chunk_id, code from bad
union all
select 'hit', query_id, rank, chunk_id, null from (select *, row_number() over (
  partition by query_id order by similarity desc, chunk_id) as rank from scored) where rank <= 20"""


@R.add("c5_damaged_vectors", DAMAGED_VECTORS_SQL)
def _c5_damaged(spark, d):
    c, q, v = F.col("chunk_id"), F.col("query_id"), F.col("embedding")
    chunks = data.chunks(spark, d).select(
        "chunk_id",
        F.when(c % 35 == 0, None).when(c % 35 == 7, F.slice(v, 1, 63))
        .when(c % 35 == 14, F.transform(v, lambda x: x * 0))
        .when(c % 35 == 21, F.transform(v, lambda x, i: F.when(i != 4, x)))
        .when(c % 35 == 28, F.transform(
            v, lambda x, i: F.when(i == 8, float("nan")).otherwise(x).cast("float")))
        .otherwise(v).alias("embedding"))
    w = F.col("query_vector")
    queries = data.query_vectors(spark, d).select(
        "query_id",
        F.when(q % 9 == 0, None).when(q % 9 == 3, F.slice(w, 1, 10))
        .when(q % 9 == 6, F.transform(w, lambda x: x * 0)).otherwise(w).alias("query_vector"))

    def listed(df, key, vector):
        return vector_violations(df, key, vector, data.DIMENSION).select(
            F.lit(key.removesuffix("_id")).alias("side"), F.col(key).alias("id"),
            F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("bigint").alias("chunk_id"),
            "code")

    hits = topk_cosine(queries, chunks, k=20).select(
        F.lit("hit").alias("side"), q.alias("id"), F.col("rank").cast("bigint").alias("rank"),
        "chunk_id", F.lit(None).cast("string").alias("code"))
    return hits.unionByName(listed(chunks, "chunk_id", "embedding")).unionByName(
        listed(queries, "query_id", "query_vector"))


def _ivf(spark, d, nprobe: int) -> DataFrame:
    queries = data.query_vectors(spark, d).select("query_id", "query_vector")
    index = ivf.build_ivf(data.chunks(spark, d).select("chunk_id", "embedding"), n_lists=8)
    return ivf.topk_ivf(queries, index, k=20, nprobe=nprobe)


@R.add("c6_topk_ivf_all_lists", data.TOPK_SQL + """
select query_id, rank, chunk_id, round(similarity, 6) as similarity from candidates""")
def _c6(spark, d):
    return _ivf(spark, d, nprobe=8).select(
        "query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


def _given_index(spark, d) -> ivf.IvfIndex:
    """A stored index whose centroids are every 63rd vector."""
    from askgrid.plans.shared import shared_folder

    chunks = data.chunks(spark, d).select("chunk_id", "embedding")
    # One more than may be: too many centroids are an error in assign_lists, never left out.
    centroids = chunks.where("chunk_id % 63 = 0").orderBy("chunk_id").limit(ivf.MAX_LISTS + 1)
    index = ivf.assign_lists(chunks, np.array([r["embedding"] for r in centroids.collect()]))
    path = shared_folder(spark)
    ivf.write_ivf(index, path)
    return ivf.read_ivf(spark, path)


IVF_SQL = data.TOPK_SQL + """,
centroids as (select row_number() over (order by chunk_id) - 1 as list_id, embedding as centroid
  from chunks where chunk_id % 63 = 0),
lists as (
  select chunk_id, list_id from (select chunk_id, list_id, row_number() over (
      partition by chunk_id order by round(list_cosine_similarity(embedding, centroid), 12) desc,
      list_id) as n from chunks, centroids) where n = 1),
probes as (
  select query_id, list_id from (select query_id, list_id, row_number() over (
      partition by query_id order by round(list_cosine_similarity(query_vector, centroid), 12) desc,
      list_id) as n from queries, centroids)
  where n <= (select ceil(count(*) * {share}) from centroids)),
near as (
  select s.*, row_number() over (partition by query_id order by similarity desc, s.chunk_id)
    as place, count(*) over (partition by query_id) as hits
  from scored s join lists using (chunk_id) join probes using (query_id, list_id)),
found as (
  select query_id, place as rank, chunk_id, similarity from near where hits >= 20 and place <= 20
  union all
  select query_id, rank, chunk_id, similarity from candidates where query_id not in (
    select query_id from near where hits >= 20))"""


# Probes grow with the lists. The given vectors are noise, so any list may hold neighbours.
PROBED_SHARE = 0.875


def _given_search(spark, d) -> DataFrame:
    queries = data.query_vectors(spark, d).select("query_id", "query_vector")
    index = _given_index(spark, d)
    return ivf.topk_ivf(queries, index, k=20, nprobe=math.ceil(index.n_lists * PROBED_SHARE))


@R.add("c6_topk_ivf", IVF_SQL.replace("{share}", str(PROBED_SHARE)) + """
select query_id, rank, chunk_id, round(similarity, 6) as similarity from found""")
def _c6p(spark, d):
    return _given_search(spark, d).select(
        "query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


@R.add("c7_ann_recall", IVF_SQL.replace("{share}", str(PROBED_SHARE)) + """
select query_id, count(f.chunk_id) as hits, count(*) as expected,
  count(f.chunk_id) / count(*) as recall
from candidates c left join found f using (query_id, chunk_id) group by 1""")
def _c7(spark, d):
    queries = data.query_vectors(spark, d).select("query_id", "query_vector")
    exact = topk_cosine(queries, data.chunks(spark, d), k=20)
    return ivf.ann_recall(_given_search(spark, d), exact, k=20)


RECALL = 0.9
#: Probes are chosen on so many queries at most, and there for a little more than is asked of all.
TUNING_QUERIES, TUNING_RECALL = 1000, 0.92


def _tuned_search(spark, d) -> DataFrame:
    """Top 20 on trained lists, probing as many of them as the wanted recall takes."""
    queries = data.query_vectors(spark, d).select("query_id", "query_vector")
    chunks = data.chunks(spark, d).select("chunk_id", "embedding")
    index = ivf.build_ivf(chunks, n_lists=ivfpq.default_lists(chunks.count()))
    sample = written(
        queries.orderBy(F.xxhash64("query_id"), "query_id").limit(TUNING_QUERIES))
    nprobe = ivf.probes_for_recall(
        sample, topk_cosine(sample, chunks, k=20), index, TUNING_RECALL)
    return ivf.topk_ivf(queries, index, k=20, nprobe=nprobe)


def c6_topk_ivf_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Training is beyond SQL: ``c7_ann_recall_kmeans`` holds the same search to its recall."""
    return _tuned_search(spark, d).select(
        "query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


@R.add("c7_ann_recall_kmeans", data.TOPK_SQL + """
select count(distinct query_id) as queries, count(*) as expected,
  ceil(0.9 * count(*))::bigint as hits_up_to_bound from candidates""")
def _c7k(spark, d):
    queries = data.query_vectors(spark, d).select("query_id", "query_vector")
    exact = topk_cosine(queries, data.chunks(spark, d), k=20)
    return ivf.ann_recall(_tuned_search(spark, d), exact, k=20).agg(
        F.count(F.lit(1)).alias("queries"), F.sum("expected").alias("expected"),
        _up_to_bound().alias("hits_up_to_bound"))


def _up_to_bound():
    """Hits, but no more than the wanted recall asks for: a number that SQL can state."""
    return F.least(F.sum("hits"), F.ceil(RECALL * F.sum("expected"))).cast("bigint")


# --- approximate search on codes --------------------------------------------------------------

def _pq_search(spark, d, scoped: bool = False):
    """Queries, the tuned index, and the chunks it was built on."""
    queries = data.query_vectors(spark, d).select(
        "query_id", "query_vector",
        *([F.array("request_id").alias("scope_knowledge_base_id")] if scoped else []))
    chunks = data.chunks(spark, d)
    return queries, ivfpq.tune(queries, ivfpq.build_pq(chunks), 20, RECALL), chunks


def c6_topk_ivfpq(spark: SparkSession, d: str) -> DataFrame:
    """Codes and training are beyond SQL: ``c7_recall_ivfpq`` holds the search to its recall."""
    queries, index, _ = _pq_search(spark, d)
    return ivfpq.topk_pq(queries, index, 20).select(
        "query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


RECALL_SQL = """select {scoped} as scoped, count(distinct query_id) as queries,
  count(*) as expected, ceil(0.9 * count(*))::bigint as hits_up_to_bound,
  count(distinct query_id) as within_a_quarter from {found}"""


def _recall_row(spark, d, scoped: bool) -> DataFrame:
    queries, index, chunks = _pq_search(spark, d, scoped)
    exact = topk_cosine(queries, chunks, k=20)
    recall = ivf.ann_recall(ivfpq.topk_pq(queries, index, 20), exact, k=20)
    read = ivfpq.effort(queries, index)
    return recall.join(read, "query_id").agg(
        F.lit(scoped).alias("scoped"), F.count(F.lit(1)).alias("queries"),
        F.sum("expected").alias("expected"), _up_to_bound().alias("hits_up_to_bound"),
        F.count_if(F.col("vectors_read") * 4 <= F.col("chunks")).alias("within_a_quarter"))


@R.add("c7_recall_ivfpq", data.TOPK_SQL + """,
own as (select * from (select *, row_number() over (partition by query_id
    order by similarity desc, chunk_id) as n from scored where knowledge_base_id = request_id)
  where n <= 20)
""" + RECALL_SQL.format(scoped="false", found="candidates") + " union all "
       + RECALL_SQL.format(scoped="true", found="own"))
def _c7pq(spark, d):
    return _recall_row(spark, d, False).unionByName(_recall_row(spark, d, True))


@R.add("c4_c6_strict_scope", data.TOPK_SQL + """
select query_id, rank, chunk_id, round(similarity, 6) as similarity from (
  select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank
  from (select query_id, chunk_id, similarity from scored
    where document_id in (query_id % 20, (query_id * 3 + 1) % 20) and section in ('s1', 's2')))
where rank <= 20""")
def _c4pq(spark, d):
    """Two documents and two sections each: fewer matches than are scored exactly, so all rows."""
    q = F.col("query_id")
    queries = data.query_vectors(spark, d).select(
        q, "query_vector", F.array(q % 20, (q * 3 + 1) % 20).alias("scope_document_id"),
        F.array(F.lit("s1"), F.lit("s2")).alias("scope_section"))
    index = ivfpq.build_pq(data.chunks(spark, d))
    return ivfpq.topk_pq(queries, index, 20, share=0.05, depth=100).select(
        "query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


@R.add("c8_fan_out", "with " + data.QUERIES_SQL + """
select request_id, query_index, query from questions""")
def _c8(spark, d):
    out = scope.fan_out(data.requests(spark, d).select("request_id", "sub_questions"))
    return out.withColumn("query_index", F.col("query_index").cast("bigint"))


# Rank 2 of every list with an even query index is lost, and some distances are made wrong.
DAMAGED_SQL = data.TOPK_SQL + """,
damaged as (
  select request_id, query_index, chunk_id,
    case when query_index = 1 and rank > 1 then rank + 1 else rank end as rank,
    case when chunk_id % 13 = 0 then 3.0 else 1 - similarity end as cosine_distance, similarity,
    case when chunk_id % 17 = 0 then upper(content_sha256) else content_sha256 end
      as content_sha256, content
  from candidates)
select code, count(*) as n from (
  select 'distance_range' as code from damaged where chunk_id % 13 = 0
  union all select 'similarity_consistent' from damaged where chunk_id % 13 = 0
  union all select 'content_sha256_format' from damaged where chunk_id % 17 = 0
  union all select 'ranks_not_contiguous' from (
    select request_id, query_index from damaged group by 1, 2
    having min(rank) <> 1 or max(rank) <> count(*)))
group by 1"""


@R.add("c9_candidate_violations", DAMAGED_SQL)
def _c9(spark, d):
    c = F.col("chunk_id")
    broken = _candidates(spark, d).withColumns({
        "rank": F.when((F.col("query_index") == 1) & (F.col("rank") > 1), F.col("rank") + 1)
        .otherwise(F.col("rank")),
        "cosine_distance": F.when(c % 13 == 0, 3.0).otherwise(F.col("cosine_distance")),
        "content_sha256": F.when(c % 17 == 0, F.upper("content_sha256")).otherwise(
            F.col("content_sha256")),
    })
    return scope.candidate_violations(broken).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# --- fusion ---------------------------------------------------------------------------------

FUSED_OUT = """request_id, chunk_id, document_id, round(rrf_score, 6) as rrf_score,
  query_hit_count, best_rank, round(best_similarity, 6) as best_similarity, first_query_index"""


def _fused_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "request_id", "chunk_id", "document_id", F.round("rrf_score", 6).alias("rrf_score"),
        "query_hit_count", "best_rank", F.round("best_similarity", 6).alias("best_similarity"),
        "first_query_index", *more,
    )


@R.add("d1_rrf_fuse", data.FUSED_SQL + f" select {FUSED_OUT} from fused")
def _d1(spark, d):
    return _fused_out(_fused(spark, d))


@R.add("d2_representative_occurrence", data.FUSED_SQL + """
select request_id, chunk_id, rank as kept_rank, query_index as kept_query_index,
  round(similarity, 6) as kept_similarity from occurrences where occurrence = 1""")
def _d2(spark, d):
    occurrences = _candidates(spark, d).withColumn("kept_rank", F.col("rank")).withColumn(
        "kept_similarity", F.round("similarity", 6))
    out = fusion.rrf_fuse(occurrences, _weights(spark, d), fields=("kept_rank", "kept_similarity"))
    return out.select("request_id", "chunk_id", "kept_rank",
                      F.col("first_query_index").alias("kept_query_index"), "kept_similarity")


@R.add("d3_fusion_order", data.FUSED_SQL + """
select request_id, chunk_id, row_number() over (partition by request_id order by
  rrf_score desc, best_rank, best_similarity desc, first_query_index, chunk_id::varchar) as place
from fused""")
def _d3(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("request_id").orderBy(*fusion.fusion_order())
    return _fused(spark, d).select(
        "request_id", "chunk_id", F.row_number().over(order).alias("place"))


@R.add("d4_dedup_content", data.FUSED_SQL + f" select {FUSED_OUT} from unique_content")
def _d4(spark, d):
    return _fused_out(fusion.dedup_content(_fused(spark, d)))


@R.add("d5_cap_per_document", data.FUSED_SQL + f" select {FUSED_OUT} from capped")
def _d5(spark, d):
    return _fused_out(fusion.cap_per_document(fusion.dedup_content(_fused(spark, d))))


@R.add("d6_limit_candidates", data.FUSED_SQL + f" select {FUSED_OUT}, rank from selected")
def _d6(spark, d):
    return _fused_out(_selected(spark, d), "rank")


@R.add("d7_fusion_counts", data.FUSED_SQL + """
select c.request_id, count(*) as raw_candidates, count(distinct c.chunk_id) as unique_chunks,
  count(distinct c.content_sha256) as unique_contents, max(s.n) as selected
from candidates c join (select request_id, count(*) as n from selected group by 1) s
  using (request_id) group by 1""")
def _d7(spark, d):
    return fusion.fusion_counts(_candidates(spark, d), _fused(spark, d), _selected(spark, d))


@R.add("d8_fusion_violations", data.FUSED_SQL + """,
broken as (
  select request_id, query_index,
    case when query_index = 2 and rank = 3 then 1000000 + request_id else chunk_id end as chunk_id,
    document_id + case when query_index = 1 and chunk_id % 3 = 0 then 1000 else 0 end
      as document_id,
    case when chunk_id % 50 = 8 then 'other' else content end as content, content_sha256
  from candidates
  union all
  select request_id, query_index, chunk_id, document_id, content, content_sha256 from candidates
  where rank = 1 and request_id % 5 = 0),
issues as (
  select request_id, 'chunk_repeated_in_list' as code from (
    select request_id, query_index, chunk_id from broken group by 1, 2, 3 having count(*) > 1)
  union all
  select request_id, 'metadata_differs' from (
    select request_id, chunk_id from broken group by 1, 2
    having count(distinct document_id || '/' || content_sha256) > 1)
  union all
  select request_id, 'hash_with_two_texts' from (
    select request_id, content_sha256 from broken group by 1, 2
    having count(distinct content) > 1)
  union all
  select request_id, 'weight_invalid' from (
    select distinct request_id, query_index from broken where query_index = 2))
select request_id, code, count(*) as n from issues group by 1, 2""")
def _d8(spark, d):
    base = _candidates(spark, d)
    again = base.where((F.col("rank") == 1) & (F.col("request_id") % 5 == 0))
    c, q = F.col("chunk_id"), F.col("query_index")
    damaged = base.withColumns({
        "chunk_id": F.when((q == 2) & (F.col("rank") == 3), 1000000 + F.col("request_id"))
        .otherwise(c),
        "document_id": F.col("document_id") + F.when((q == 1) & (c % 3 == 0), 1000).otherwise(0),
        "content": F.when(c % 50 == 8, "other").otherwise(F.col("content")),
    })
    weights = _weights(spark, d).withColumn(
        "weight", F.when(F.col("query_index") == 2, 0.0).otherwise(F.col("weight")))
    return fusion.fusion_violations(damaged.unionByName(again), weights)


# --- rerank, context, prompt ----------------------------------------------------------------

RERANK_SQL = data.FUSED_SQL + """,
sizes as (select request_id, count(*) as size from selected group by 1),
status as (select request_id, case request_id % 6 when 0 then 'disabled' when 1 then 'timeout'
  else 'ok' end as status from requests),
results as (
  select s.request_id, least(10, z.size) - s.rank + 1 as position,
    case when s.request_id % 6 = 3 then 0 else s.rank - 1 end as original_index, s.chunk_id,
    case when s.request_id % 6 = 4 then 0.05 * (least(10, z.size) - s.rank + 1)
      else 0.05 * s.rank end as score
  from selected s join sizes z using (request_id)
  where s.rank <= least(10, z.size) and not (s.request_id % 6 = 2 and s.rank = 1)),
final as (
  select s.*, z.size, case s.request_id % 6 when 0 then 'disabled' when 1 then 'timeout'
    when 5 then null else 'protocol' end as degradation_reason
  from selected s join sizes z using (request_id))"""


def _rerank_inputs(spark, d):
    from pyspark.sql import Window

    # Read three times below: written once instead of searching the chunks three times.
    selected = written(_selected(spark, d))
    sized = selected.withColumn(
        "_n", F.least(F.lit(10), F.count(F.lit(1)).over(Window.partitionBy("request_id"))))
    kind, rank = F.col("request_id") % 6, F.col("rank")
    position = F.col("_n") - rank + 1
    results = sized.where((rank <= F.col("_n")) & ~((kind == 2) & (rank == 1))).select(
        "request_id",
        position.alias("position"),
        F.when(kind == 3, 0).otherwise(rank - 1).cast("bigint").alias("original_index"),
        "chunk_id",
        F.when(kind == 4, 0.05 * position).otherwise(0.05 * rank).alias("score"),
    )
    status = data.requests(spark, d).select(
        "request_id",
        F.when(kind == 0, "disabled").when(kind == 1, "timeout").otherwise("ok").alias("status"),
    )
    return selected, results, status


RERANKED_OUT = RERANK_SQL + """
select request_id, chunk_id, f.rank as fusion_rank,
  case when degradation_reason is null then least(10, size) - f.rank + 1 else f.rank end as rank,
  degradation_reason from final f where f.rank <= least(10, size)"""


@R.add("d9_d10_rerank_or_fallback", RERANKED_OUT)
def _d9(spark, d):
    out = rerank.apply_rerank(*_rerank_inputs(spark, d), top_k=10)
    return out.select("request_id", "chunk_id", "fusion_rank", "rank", "degradation_reason")


@R.add("d11_score_pairs", data.FUSED_SQL + """,
pairs as (
  select s.request_id, s.rank - 1 as original_index, r.question as query, x.text as passage
  from selected s join requests r using (request_id) join documents x on x.doc_id = s.chunk_id),
words as (
  select *, list_distinct(list_filter(string_split_regex(lower(query), '\\s+'),
      lambda w: w <> '')) as qw,
    list_distinct(list_filter(string_split_regex(lower(passage), '\\s+'),
      lambda w: w <> '')) as pw from pairs),
pair_scores as (
  select request_id, original_index,
    coalesce(len(list_intersect(qw, pw)) / nullif(len(qw), 0), 0) as score from words)
select request_id, original_index, round(score, 6) as score, position from (
  select *, row_number() over (partition by request_id
    order by score desc, original_index) as position from pair_scores) where position <= 10""")
def _d11(spark, d):
    passages = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("passage"))
    pairs = (
        _selected(spark, d)
        .withColumn("original_index", (F.col("rank") - 1).cast("bigint"))
        .join(data.requests(spark, d).select("request_id", F.col("question").alias("query")),
              "request_id")
        .join(passages, "chunk_id")
    )
    return rerank.score_pairs(pairs).select(
        "request_id", "original_index", F.round("score", 6).alias("score"), "position")


@R.add("d12_select_context", RERANKED_OUT.replace(
    "select request_id, chunk_id, f.rank as fusion_rank,", "select request_id, chunk_id,").replace(
    "else f.rank end as rank,\n  degradation_reason", "else f.rank end as citation_number"))
def _d12(spark, d):
    ranked = rerank.apply_rerank(*_rerank_inputs(spark, d), top_k=10)
    return prompt.select_context(ranked).select("request_id", "chunk_id", "citation_number")


ESCAPE = ("replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),"
          " '\"', '&quot;'), '''', '&#x27;')")


@R.add("d13_build_prompts", data.FUSED_SQL + f""",
blocks as (
  select s.request_id, s.rank, '<source id="' || s.rank || '" document="src ' || {ESCAPE.format(
      'x.source')} || '" source_key="k&amp;' || s.document_id || '" section="s' ||
      (s.chunk_id % 4) || '"' || case when s.chunk_id % 2 = 0 then ' page="' ||
      (s.chunk_id % 7 + 1) || '"' else '' end || '>' || chr(10) || {ESCAPE.format('x.text')}
      || chr(10) || '</source>' as block
  from selected s join documents x on x.doc_id = s.chunk_id where s.rank <= 10)
select b.request_id, count(*) as n_sources, sha256(
    case when b.request_id % 2 = 0 then '<conversation_memory>' || chr(10) || '<summary>' || chr(10)
      || 'said &lt;b&gt; ' || b.request_id || chr(10) || '</summary>' || chr(10)
      || '<message role="user">' || {ESCAPE.format('max(r.question)')} || '</message>'
      || chr(10) || '</conversation_memory>' || chr(10) else '' end
    || '<knowledge_context>' || chr(10) || string_agg(block, chr(10) order by rank) || chr(10)
    || '</knowledge_context>' || chr(10) || '<question>' || chr(10)
    || {ESCAPE.format('trim(max(r.question))')} || chr(10) || '</question>') as prompt_sha256
from blocks b join requests r using (request_id) group by 1""")
def _d13(spark, d):
    texts = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source")
    c = F.col("chunk_id")
    context = attach_facts(prompt.select_context(_selected(spark, d)), texts).select(
        "request_id", "citation_number", "content",
        F.concat(F.lit("src "), "source").alias("display_name"),
        F.concat(F.lit("k&"), F.col("document_id").cast("string")).alias("source_key"),
        F.concat(F.lit("s"), (c % 4).cast("string")).alias("section"),
        F.when(c % 2 == 0, c % 7 + 1).alias("page_number"),
    )
    requests = data.requests(spark, d).select("request_id", "question")
    memory = requests.where(F.col("request_id") % 2 == 0).select(
        "request_id",
        F.concat(F.lit("said <b> "), F.col("request_id").cast("string")).alias("summary"),
        F.array(F.struct(F.lit(1).cast("bigint").alias("ordinal"), F.lit("user").alias("role"),
                         F.col("question").alias("content"))).alias("messages"),
    )
    out = prompt.build_prompts(context, requests, memory)
    return out.select("request_id", "n_sources", F.sha2("user_prompt", 256).alias("prompt_sha256"))


@R.add("d14_no_context", "with " + data.REQUESTS_SQL + """, found as (
  select distinct request_id from (select request_id, unnest(scope_knowledge_base_id) as kb
    from requests) where kb < 5)
select request_id, 'no_context' as outcome from requests
where request_id not in (select request_id from found)""")
def _d14(spark, d):
    reqs = data.requests(spark, d)
    found = reqs.select("request_id", F.explode("scope_knowledge_base_id").alias("kb")).where(
        "kb < 5")
    return fusion.no_context(reqs, found).select("request_id", "outcome")
