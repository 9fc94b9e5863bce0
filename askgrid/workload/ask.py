"""Queries over the whole question side and knowledge base creation."""

from __future__ import annotations

from pyspark.sql import functions as F

from askgrid.functions.vectors import hash_vector
from askgrid.operators.knowledge_bases import create_knowledge_bases
from askgrid.operators.understanding import select_route
from askgrid.plans.ask import prepare_batch
from askgrid.workload import data
from askgrid.workload.data import CONFIG, DIMENSION, Registry, table
from askgrid.workload.understanding import decision_sql

R = Registry()


def routed(spark, d):
    r = F.col("request_id")
    scored = data.requests(spark, d).select(
        "request_id", "question", "sub_questions", F.col("question").alias("rewritten_question"),
        ((r * 37 + 11) % 101 / 100).alias("system_direct_score"),
        ((r * 53 + 70) % 101 / 100).alias("knowledge_base_score"),
        ((r * 71 + 5) % 101 / 100).alias("clarification_score"),
        F.when(r % 3 == 0, "intent_classifier_timeout").alias("degradation_reason"),
    )
    return select_route(scored)


def embed_questions(df):
    return df.withColumn("query_vector", hash_vector(F.col("query"), DIMENSION))


def ask(spark, d):
    chunks = data.chunks(spark, d).withColumns({
        "display_name": F.concat(F.lit("doc "), F.col("document_id").cast("string")),
        "source_key": F.col("document_id").cast("string"),
    })
    return prepare_batch(routed(spark, d), chunks, data.knowledge_bases(spark, d), CONFIG,
                         embed_questions)


ASK_SQL = data.FUSED_SQL.replace(
    "from queries q, chunks c)", "from queries q, chunks c where c.knowledge_base_id <> 9)"
).replace("1.0 / (1 + query_index) as weight", "1.0 as weight").replace(
    "where rank <= 25)", "where rank <= 40)") + """,
asked as (
  select request_id, question, ((request_id * 37 + 11) % 101) / 100 as sd,
    ((request_id * 53 + 70) % 101) / 100 as kb, ((request_id * 71 + 5) % 101) / 100 as cl,
    case when request_id % 3 = 0 then 'intent_classifier_timeout' end as degradation_reason
  from requests), """ + decision_sql("asked")


@R.add("ask_batch_outcomes", ASK_SQL + """
select d.request_id, case route when 'clarification' then 'clarification' when 'system_direct'
    then 'direct' else 'answer' end as outcome,
  case when route = 'knowledge_base' then (select count(*) from selected s
    where s.request_id = d.request_id and s.rank <= 10) else 0 end as n_sources
from decisions d""")
def _outcomes(spark, d):
    return ask(spark, d).outcomes.select("request_id", "outcome", "n_sources")


# Slugs of known, unknown and incompatible bases (9 has another index), by the request's number.
ASK_SLUGS_SQL = "with " + data.CHUNKS_SQL + ", " + data.QUERIES_SQL + """,
asked as (
  select request_id, question, ((request_id * 37 + 11) % 101) / 100 as sd,
    ((request_id * 53 + 70) % 101) / 100 as kb, ((request_id * 71 + 5) % 101) / 100 as cl,
    case when request_id % 3 = 0 then 'intent_classifier_timeout' end as degradation_reason
  from requests), """ + decision_sql("asked") + """,
named as (
  select request_id, route, case when route <> 'knowledge_base' or request_id % 5 < 2 then null
    when request_id % 5 in (2, 3) then 'knowledge_base_not_found'
    else 'index_configuration_mismatch' end as error_code from decisions),
candidates as (
  select * from (
    select q.request_id, q.query_index, c.chunk_id, c.content_sha256, c.document_id,
      round(list_cosine_similarity(q.query_vector, c.embedding), 12) as similarity,
      row_number() over (partition by q.query_id
        order by round(list_cosine_similarity(q.query_vector, c.embedding), 12) desc,
          c.chunk_id) as rank
    from queries q join named n using (request_id) join chunks c on c.knowledge_base_id <> 9
      and c.document_id % 3 <> 0
      and (n.request_id % 5 = 0 or c.knowledge_base_id in (n.request_id % 4, n.request_id % 4 + 4))
    where n.route = 'knowledge_base' and n.error_code is null) where rank <= 20),
fused as (
  select request_id, chunk_id, sum(1.0 / (60 + rank)) as score, min(rank) as best_rank,
    max(similarity) as best, any_value(document_id) as document_id,
    any_value(content_sha256) as content_sha256,
    arg_min(query_index, (rank, -similarity, query_index)) as first_query
  from candidates group by 1, 2),
one as (
  select * from fused qualify row_number() over (partition by request_id, content_sha256
    order by score desc, best_rank, best desc, first_query, chunk_id::varchar) = 1),
capped as (
  select * from one qualify row_number() over (partition by request_id, document_id
    order by score desc, best_rank, best desc, first_query, chunk_id::varchar) <= 2),
sources as (select request_id, least(10, count(*)) as n from capped group by 1)
select request_id, error_code, coalesce(n, 0) as n_sources,
  case when error_code is not null then 'failed' when route = 'clarification' then 'clarification'
    when route = 'system_direct' then 'direct' when n > 0 then 'answer' else 'no_context' end
    as outcome
from named left join sources using (request_id)"""


@R.add("ask_batch_slugs", ASK_SLUGS_SQL)
def _slugs(spark, d):
    """Directed questions: no slug, known, partly unknown, unknown and incompatible ones."""
    r = F.col("request_id")

    def kb(n):
        return F.concat(F.lit("kb-"), n.cast("string"))

    slugs = (
        F.when(r % 5 == 0, F.array().cast("array<string>"))
        .when(r % 5 == 1, F.array(kb(r % 4), kb(r % 4 + 4)))
        .when(r % 5 == 2, F.array(kb(r % 4), F.lit("typo")))
        .when(r % 5 == 3, F.array(F.lit("typo")))
        .otherwise(F.array(kb(r % 4), F.lit("kb-9")))
    )
    chunks = data.chunks(spark, d).withColumns({
        "display_name": F.concat(F.lit("doc "), F.col("document_id").cast("string")),
        "source_key": F.col("document_id").cast("string"),
        "version_id": F.col("document_id"),
    })
    versions = chunks.select("version_id").distinct().withColumn(
        "status", F.when(F.col("version_id") % 3 == 0, "superseded").otherwise("active"))
    asked = prepare_batch(routed(spark, d).withColumn("slugs", slugs), chunks,
                          data.knowledge_bases(spark, d), CONFIG, embed_questions,
                          versions=versions)
    return asked.outcomes.select("request_id", "error_code", "n_sources", "outcome")


@R.add("ask_batch_context", ASK_SQL + """
select s.request_id, s.rank as citation_number, s.chunk_id, s.document_id
from selected s join decisions d using (request_id)
where s.rank <= 10 and d.route = 'knowledge_base'""")
def _context(spark, d):
    return ask(spark, d).context.select(
        "request_id", "citation_number", "chunk_id", "document_id")


@R.add("ask_batch_prompts", ASK_SQL + """
select s.request_id, count(*) as n_sources, sha256('<knowledge_context>' || chr(10) ||
  string_agg('<source id="' || s.rank || '" document="doc ' || s.document_id || '" source_key="'
    || s.document_id || '" section="' || c.section || '" page="' || c.page_number || '">'
    || chr(10) || c.content || chr(10) || '</source>', chr(10) order by s.rank) || chr(10)
  || '</knowledge_context>' || chr(10) || '<question>' || chr(10)
  || trim(replace(max(d.question), '''', '&#x27;')) || chr(10) || '</question>') as prompt_sha256
from selected s join decisions d using (request_id) join chunks c using (chunk_id)
where s.rank <= 10 and d.route = 'knowledge_base' group by 1""")
def _prompts(spark, d):
    return ask(spark, d).prompts.select(
        "request_id", "n_sources", F.sha2("user_prompt", 256).alias("prompt_sha256"))


@R.add("create_knowledge_bases", r"""
with drafts as (
  select doc_id as draft_seq, source || '-' || lang as slug, case when doc_id % 10 = 0 then ''
    else 'name' end as name, doc_id % 7 = 0 as bad_slug from documents),
valid as (select *, row_number() over (partition by slug order by draft_seq) as n from drafts
  where name <> '' and not bad_slug)
select draft_seq, case when bad_slug then slug || '-' else slug end as slug,
  case when bad_slug then 'slug_invalid' when name = '' then 'name_invalid'
    when slug like '%-de' then 'knowledge_base_conflict'
    when draft_seq not in (select draft_seq from valid where n = 1)
      then 'knowledge_base_conflict' else 'created' end as result
from drafts""")
def _create(spark, d):
    docs = table(spark, d, "documents")
    slug = F.concat("source", F.lit("-"), "lang")
    drafts = docs.select(
        F.col("doc_id").alias("draft_seq"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(slug, F.lit("-"))).otherwise(
            F.concat(F.lit(" "), F.upper(slug))).alias("slug"),
        F.when(F.col("doc_id") % 10 == 0, " ").otherwise(" name ").alias("name"),
        F.lit(None).cast("string").alias("description"),
    )
    stored = docs.where("lang = 'de'").select(slug.alias("slug")).distinct()
    created, rejects = create_knowledge_bases(stored, drafts, CONFIG)
    firsts = rejects.select("draft_seq", "slug", F.col("reject_code").alias("result"))
    made = created.select("slug").join(
        drafts.select(F.lower(F.trim("slug")).alias("slug"), "draft_seq", "name").where(
            "trim(name) <> ''").groupBy("slug").agg(F.min("draft_seq").alias("draft_seq")), "slug")
    return firsts.unionByName(made.select("draft_seq", "slug", F.lit("created").alias("result")))
