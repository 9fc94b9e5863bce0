"""The driver's tables as operator inputs, in Spark and as SQL text for the check.

Every input covers its whole source table and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.functions.vectors import hash_vector
from askgrid.operators.scope import IndexConfig
from askgrid.plans.shared import spread

DIMENSION = 64
CONFIG = IndexConfig("hash-embedder", "r1", DIMENSION, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents spread over the cores where the file has fewer splits than that."""
    return spread(table(spark, folder, "documents"), "doc_id")


class Registry:
    """Queries of one topic with their SQL twins."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


# --- chunks, knowledge bases, requests ------------------------------------------------------

def chunks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    content = F.concat(F.lit("c"), (v - F.when(v % 10 == 9, 1).otherwise(0)).cast("string"))
    return table(spark, d, "embeddings").select(
        v.alias("chunk_id"),
        F.expr("vec_id div 25").alias("document_id"),
        F.col("label").alias("knowledge_base_id"),
        "embedding",
        content.alias("content"),
        F.sha2(content, 256).alias("content_sha256"),
        F.concat(F.lit("s"), (v % 4).cast("string")).alias("section"),
        (v % 7 + 1).cast("int").alias("page_number"),
        F.when(v % 3 == 0, "markdown").when(v % 3 == 1, "csv").otherwise("plain_text").alias(
            "document_format"),
        F.concat(F.lit("p"), (v % 2).cast("string")).alias("parser_name"),
    )


CHUNKS_SQL = """chunks as (
  select vec_id as chunk_id, vec_id // 25 as document_id, label as knowledge_base_id,
    embedding::double[] as embedding,
    'c' || (vec_id - case when vec_id % 10 = 9 then 1 else 0 end) as content,
    sha256('c' || (vec_id - case when vec_id % 10 = 9 then 1 else 0 end)) as content_sha256,
    's' || (vec_id % 4) as section, (vec_id % 7 + 1)::int as page_number,
    case vec_id % 3 when 0 then 'markdown' when 1 then 'csv' else 'plain_text' end
      as document_format,
    'p' || (vec_id % 2) as parser_name
  from embeddings)"""


def knowledge_bases(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "embeddings")
        .select(F.col("label").alias("knowledge_base_id"))
        .distinct()
        .select(
            "knowledge_base_id",
            F.concat(F.lit("kb-"), F.col("knowledge_base_id").cast("string")).alias("slug"),
            F.lit("hash-embedder").alias("embedding_model_id"),
            F.when(F.col("knowledge_base_id") == 9, "r2").otherwise("r1").alias(
                "embedding_model_revision"),
            F.lit(DIMENSION).alias("embedding_dimension"),
            F.lit(True).alias("embedding_normalized"),
        )
    )


KBS_SQL = """kbs as (
  select distinct label as knowledge_base_id, 'kb-' || label as slug,
    'hash-embedder' as embedding_model_id,
    case when label = 9 then 'r2' else 'r1' end as embedding_model_revision,
    64 as embedding_dimension, true as embedding_normalized
  from embeddings)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per benchmark item, with one to three sub-questions and a scope."""
    r, text = F.col("item_id"), F.col("text")
    ints = "array<int>"
    return table(spark, d, "benchmark").select(
        r.alias("request_id"),
        text.alias("question"),
        F.slice(
            F.array(text, F.concat(text, F.lit("?")), F.concat(F.lit("re: "), text)),
            F.lit(1), (r % 3 + 1).cast("int"),
        ).alias("sub_questions"),
        F.when(r % 4 == 0, F.array().cast(ints))
        .when(r % 4 == 1, F.array((r % 9).cast("int"), F.lit(9), F.lit(77)))
        .otherwise(F.array((r % 9).cast("int"), ((r + 1) % 9).cast("int"),
                           ((r + 2) % 9).cast("int"), (r % 9).cast("int")))
        .alias("scope_knowledge_base_id"),
        F.when(r % 6 == 5, F.sequence(F.lit(0), F.lit(9)).cast("array<bigint>"))
        .otherwise(F.array().cast("array<bigint>")).alias("scope_document_id"),
        F.when(r % 7 == 3, F.array(F.lit("markdown"), F.lit("csv")))
        .otherwise(F.array().cast("array<string>")).alias("scope_document_format"),
        F.when(r % 5 == 2, F.array(F.lit(" s0"), F.lit("s1 "), F.lit("s0")))
        .otherwise(F.array().cast("array<string>")).alias("scope_section"),
        F.when(r % 3 == 1, F.array(F.lit(1), F.lit(2), F.lit(3)))
        .when(r % 11 == 9, F.array(F.lit(0), F.lit(5)))
        .otherwise(F.array().cast(ints)).alias("scope_page_number"),
    )


REQUESTS_SQL = """requests as (
  select item_id as request_id, text as question,
    ([text, text || '?', 're: ' || text])[1:(item_id % 3 + 1)] as sub_questions,
    case when item_id % 4 = 0 then []::int[]
      when item_id % 4 = 1 then [(item_id % 9)::int, 9, 77]
      else [(item_id % 9)::int, ((item_id + 1) % 9)::int, ((item_id + 2) % 9)::int,
            (item_id % 9)::int] end as scope_knowledge_base_id,
    case when item_id % 6 = 5 then range(0, 10) else []::bigint[] end as scope_document_id,
    case when item_id % 7 = 3 then ['markdown', 'csv'] else []::varchar[] end
      as scope_document_format,
    case when item_id % 5 = 2 then [' s0', 's1 ', 's0'] else []::varchar[] end as scope_section,
    case when item_id % 3 = 1 then [1, 2, 3] when item_id % 11 = 9 then [0, 5]
      else []::int[] end as scope_page_number
  from benchmark)"""

HEX = "strpos('0123456789abcdef', substr({h}, {p}, 1)) - 1"
VECTOR_SQL = (
    "list_transform(range(0, 64), lambda i: (("
    + HEX.format(h="sha256({q})", p="(i % 32) * 2 + 1")
    + ") * 16 + "
    + HEX.format(h="sha256({q})", p="(i % 32) * 2 + 2")
    + " - 127.5) / 127.5)"
)


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``query_id, request_id, query_index, query, query_vector`` for every sub-question."""
    from askgrid.operators.scope import fan_out

    fanned = fan_out(requests(spark, d).select("request_id", "sub_questions"))
    return fanned.select(
        (F.col("request_id") * 4 + F.col("query_index")).alias("query_id"),
        "request_id",
        F.col("query_index").cast("bigint").alias("query_index"),
        "query",
        hash_vector(F.col("query"), DIMENSION).alias("query_vector"),
    )


QUERIES_SQL = (
    REQUESTS_SQL
    + """, questions as (
  select request_id, i - 1 as query_index, sub_questions[i] as query
  from (select request_id, sub_questions, unnest(range(1, len(sub_questions) + 1)) as i
        from requests)),
queries as (
  select request_id * 4 + query_index as query_id, request_id, query_index, query, """
    + VECTOR_SQL.format(q="query")
    + """ as query_vector from questions)"""
)

# Top 20 per query over all chunks; similarity is compared at 12 decimals, as the operator does.
TOPK_SQL = (
    "with " + CHUNKS_SQL + ", " + QUERIES_SQL + """,
scored as (
  select q.query_id, q.request_id, q.query_index, c.chunk_id, c.document_id, c.content,
    c.content_sha256, c.knowledge_base_id, c.section, c.page_number,
    round(list_cosine_similarity(q.query_vector, c.embedding), 12) as similarity
  from queries q, chunks c),
candidates as (
  select * from (select *, row_number() over (
      partition by query_id order by similarity desc, chunk_id) as rank from scored)
  where rank <= 20)"""
)

FUSED_SQL = TOPK_SQL + """,
weights as (select distinct request_id, query_index, 1.0 / (1 + query_index) as weight
  from queries),
occurrences as (
  select c.*, w.weight / (60 + c.rank) as term,
    row_number() over (partition by c.request_id, c.chunk_id
      order by c.rank, c.similarity desc, c.query_index) as occurrence
  from candidates c join weights w using (request_id, query_index)),
fused as (
  select request_id, chunk_id, list_sum(list(term order by query_index)) as rrf_score,
    count(*) as query_hit_count, min(rank) as best_rank, max(similarity) as best_similarity,
    max(case when occurrence = 1 then query_index end) as first_query_index,
    max(case when occurrence = 1 then document_id end) as document_id,
    max(case when occurrence = 1 then content_sha256 end) as content_sha256
  from occurrences group by 1, 2),
unique_content as (
  select * from (select *, row_number() over (partition by request_id, content_sha256
    order by rrf_score desc, best_rank, best_similarity desc, first_query_index,
      chunk_id::varchar) as n from fused) where n = 1),
capped as (
  select * from (select *, row_number() over (partition by request_id, document_id
    order by rrf_score desc, best_rank, best_similarity desc, first_query_index,
      chunk_id::varchar) as m from unique_content) where m <= 2),
selected as (
  select * from (select *, row_number() over (partition by request_id
    order by rrf_score desc, best_rank, best_similarity desc, first_query_index,
      chunk_id::varchar) as rank from capped) where rank <= 25)"""
