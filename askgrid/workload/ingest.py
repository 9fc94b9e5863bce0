"""Queries over sources, admission, segmentation, chunking, embedding and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from askgrid.operators import admission, chunking, embedding, integrity, scope, segment, versions
from askgrid.plans.shared import written
from askgrid.sources.corpus import extract_front_matter_id
from askgrid.workload import data
from askgrid.workload.conversations import MESSAGES_SQL, RUNS_SQL, messages, runs
from askgrid.sources import corpus
from askgrid.workload.data import CONFIG, Registry, table

R = Registry()


# --- sources --------------------------------------------------------------------------------

@R.add("a3_front_matter_id", """
select doc_id, case when doc_id % 5 = 0 then 'doc_id_missing' when doc_id % 5 = 1
  then 'doc_id_repeated' else '' end as reject_code,
  case when doc_id % 5 > 1 then 'DOC_' || doc_id else '' end as doc_key from documents""")
def _a3(spark, d):
    i = F.col("doc_id") % 5
    line = F.concat(F.lit("doc_id: DOC_"), F.col("doc_id").cast("string"), F.lit("\n"))
    head = F.when(i == 0, "").when(i == 1, F.concat(line, line)).otherwise(line)
    rows = data.documents(spark, d).select("doc_id", F.concat(head, "text").alias("text"))
    good, bad = extract_front_matter_id(rows)
    return good.select("doc_id", F.lit("").alias("reject_code"), "doc_key").unionByName(
        bad.select("doc_id", "reject_code", F.lit("").alias("doc_key")))


# --- admission ------------------------------------------------------------------------------

LIMITS = {"max_bytes": 20_000, "max_chars": 8_000}


def uploads(spark, d):
    """Documents as uploaded files, some empty, mistyped, binary or badly encoded."""
    n, m, k = F.col("doc_id") % 8, F.col("doc_id") % 5, F.col("doc_id") % 13
    names = ["a.txt", "dir\\b.MD", "c.csv", "d.pdf", "e.exe", "plain", "x/f.TXT", ".txt"]
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    media = (
        F.when(m == 0, "text/plain").when(m == 1, "application/octet-stream")
        .when(m == 2, F.lit(None)).when(m == 3, " Text/Markdown; charset=utf-8")
        .otherwise("image/png")
    )
    raw = F.col("text").cast("binary")
    content = (
        F.when(k == 0, F.lit("").cast("binary"))
        .when(k == 1, F.concat(raw, F.unhex(F.lit("00"))))
        .when(k == 2, F.concat(raw, F.unhex(F.lit("FF"))))
        .when(k == 3, F.concat(raw, F.unhex(F.lit("07"))))
        .when(k == 4, F.concat(F.unhex(F.lit("EFBBBF")),
                               F.replace("text", F.lit("\n"), F.lit("\r\n")).cast("binary")))
        .otherwise(raw)
    )
    return data.documents(spark, d).select(
        "doc_id", name.alias("filename"), media.alias("media_type"), content.alias("content"))


UPLOADS_SQL = r"""uploads as (
  select doc_id, text, doc_id % 13 as k,
    (['.txt', '.md', '.csv', '.pdf', '.exe', '', '.txt', ''])[doc_id % 8 + 1] as ext,
    case doc_id % 5 when 0 then 'text/plain' when 1 then 'application/octet-stream'
      when 3 then 'text/markdown' when 4 then 'image/png' end as media,
    case doc_id % 13 when 0 then 0 when 4 then octet_length(encode(replace(text, chr(10),
      chr(13) || chr(10)))) + 3 else octet_length(encode(text))
      + case when doc_id % 13 in (1, 2, 3) then 1 else 0 end end as bytes from documents),
formats as (
  select *, case ext when '.txt' then 'plain_text' when '.md' then 'markdown'
      when '.csv' then 'csv' when '.pdf' then 'pdf' end as by_ext,
    case media when 'text/plain' then 'plain_text' when 'text/markdown' then 'markdown' end
      as by_media from uploads),
typed as (
  select *, coalesce(by_ext, by_media) as fmt, case
    when ext <> '' and by_ext is null then 'unsupported_type'
    when by_ext is not null and media is not null and media <> 'application/octet-stream'
      and by_media is null then 'type_mismatch'
    when by_ext <> by_media then 'type_mismatch'
    when by_ext is null and by_media is null then 'unsupported_type' end as type_code
  from formats),
admitted as (
  select *, case when bytes = 0 then 'empty_file' when bytes > 20000 then 'file_too_large'
    when type_code is not null then type_code when fmt = 'pdf' then 'invalid_file_signature'
    when k = 1 then 'binary_content' when k = 2 then 'invalid_encoding'
    when length(text) + case when k = 3 then 1 else 0 end > 8000 then 'resource_limit_exceeded'
    when k = 3 then 'binary_content' end as reject_code from typed)"""


@R.add("a4_a5_a6_admission_rejects", "with " + UPLOADS_SQL + """
select doc_id, reject_code from admitted where reject_code is not null""")
def _a4(spark, d):
    _, rejects = admission.admit_documents(uploads(spark, d), **LIMITS)
    return rejects.select("doc_id", "reject_code")


@R.add("a4_a5_a6_admitted", "with " + UPLOADS_SQL + """
select doc_id, fmt as document_format, bytes as byte_size, sha256(text) as text_sha256
from admitted where reject_code is null""")
def _a4a(spark, d):
    accepted, _ = admission.admit_documents(uploads(spark, d), **LIMITS)
    return accepted.select("doc_id", "document_format", "byte_size",
                           F.sha2("text", 256).alias("text_sha256"))


@R.add("a7_content_fingerprint", """
select doc_id, sha256(text) as content_sha256 from documents""")
def _a7(spark, d):
    rows = data.documents(spark, d).withColumns({
        "content": F.col("text").cast("binary"), "filename": F.lit("a.txt"),
        "media_type": F.lit("text/plain")}).drop("text")
    return admission.identify(rows).select("doc_id", "content_sha256")


# --- segmentation and chunking --------------------------------------------------------------

def spaced(spark, d):
    """Documents with a blank line after every third line."""
    text = F.array_join(
        F.transform(F.split("text", "\n"), lambda line, i: F.concat(
            line, F.when((i + 1) % 3 == 0, "\n").otherwise(""))), "\n")
    return data.documents(spark, d).select("doc_id", text.alias("text"), "source", "lang")


LINES_SQL = r"""lines as (
  select doc_id, i + (i - 1) // 3 as line_no, (i - 1) // 3 as run, parts[i] as line
  from (select doc_id, string_split(text, chr(10)) as parts,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
runs_of as (
  select doc_id, line_no, regexp_replace(line, '\s+$', '') as line,
    line_no - row_number() over (partition by doc_id order by line_no) as island
  from lines where regexp_matches(line, '\S')),
paragraphs as (
  select doc_id, row_number() over (partition by doc_id order by min(line_no)) - 1 as ordinal,
    min(line_no) as start_line, max(line_no) as end_line,
    regexp_replace(string_agg(line, chr(10) order by line_no), '^\s+|\s+$', '', 'g') as text
  from runs_of group by doc_id, island)"""


@R.add("a8_segment_paragraphs", "with " + LINES_SQL + """
select doc_id, ordinal, start_line, end_line, sha256(text) as text_sha256 from paragraphs""")
def _a8(spark, d):
    return segment.segment_paragraphs(spaced(spark, d)).select(
        "doc_id", "ordinal", "start_line", "end_line", F.sha2("text", 256).alias("text_sha256"))


def markdown_head():
    """Markdown ahead of a text: headings, a list with a second paragraph, a fence, a quote and
    indented code."""
    return F.concat(
        F.lit("# "), "source", F.lit("\n\n- *first* "), "lang",
        F.lit("\n- second\n\n  more &amp; more\n\n## Text **of** "), "lang",
        F.lit("\n\n```sql\nselect 1;\n\n# no heading\n```\n\n> quoted <https://x.y/"), "lang",
        F.lit(">\n> line\n\n    indented\n\n"))


def markdown(spark, d):
    """Documents as Markdown: the head, then all lines of the text without the characters that have
    a meaning, so that SQL can follow."""
    plain = F.array_join(F.transform(F.split("text", "\n"), lambda line: F.concat(
        F.lit("L "), F.regexp_replace(line, r"[^\p{L}\p{N} .,]", ""))), "\n")
    return data.documents(spark, d).select(
        "doc_id", F.concat(markdown_head(), plain).alias("text"))


def whole_markdown(spark, d):
    """Documents as Markdown: the head, then the whole text unaltered, in paragraphs."""
    return spaced(spark, d).select("doc_id", F.concat(markdown_head(), "text").alias("text"))


MARKDOWN_SQL = r"""
with d as (
  select doc_id, source, lang, list_transform(string_split(text, chr(10)), lambda l:
    trim('L ' || regexp_replace(l, '[^\p{L}\p{N} .,]', '', 'g'))) as lines from documents),
blocks as (
  select doc_id, unnest([
    {'o': 0, 'k': 'heading', 's': 1, 'e': 1, 'h': 1, 'c': null, 't': source},
    {'o': 1, 'k': 'list_item', 's': 3, 'e': 3, 'h': null, 'c': null, 't': 'first ' || lang},
    {'o': 2, 'k': 'list_item', 's': 4, 'e': 4, 'h': null, 'c': null, 't': 'second'},
    {'o': 3, 'k': 'list_item', 's': 6, 'e': 6, 'h': null, 'c': null, 't': 'more & more'},
    {'o': 4, 'k': 'heading', 's': 8, 'e': 8, 'h': 2, 'c': null, 't': 'Text of ' || lang},
    {'o': 5, 'k': 'code_block', 's': 10, 'e': 14, 'h': null, 'c': 'sql',
      't': 'select 1;' || chr(10) || chr(10) || '# no heading'},
    {'o': 6, 'k': 'paragraph', 's': 16, 'e': 17, 'h': null, 'c': null,
      't': 'quoted https://x.y/' || lang || chr(10) || 'line'},
    {'o': 7, 'k': 'code_block', 's': 19, 'e': 19, 'h': null, 'c': null, 't': 'indented'},
    {'o': 8, 'k': 'paragraph', 's': 21, 'e': 20 + len(lines), 'h': null, 'c': null,
      't': array_to_string(lines, chr(10))}]) as b,
    source, lang from d)
select doc_id, b.o as ordinal, b.k as kind, b.s as start_line, b.e as end_line,
  b.h as heading_level, b.c as code_language, sha256(b.t) as text_sha256,
  case when b.o < 4 then source else source || ' > Text of ' || lang end as section
from blocks"""


def _markdown_blocks(docs):
    return segment.segment_markdown(docs).select(
        "doc_id", "ordinal", "kind", "start_line", "end_line", "heading_level", "code_language",
        F.array_join("section_path", " > ").alias("section"),
        F.sha2("text", 256).alias("text_sha256"))


@R.add("a9_segment_markdown", MARKDOWN_SQL)
def _a9(spark, d):
    return _markdown_blocks(markdown(spark, d))


def a9_segment_markdown_whole(spark, d):
    """Whole texts have marks of all kinds: a test compares with brute force on small documents."""
    return _markdown_blocks(whole_markdown(spark, d))


@R.add("a10_segment_csv", r"""
with base as (select doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') as t, source,
  len(string_split(text, chr(10))) as n from documents)
select doc_id, 0 as ordinal, 2 as start_line, n + 1 as end_line,
  sha256('id: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'lang (2): ' || t
    || chr(10) || '列 4: ' || source) as text_sha256 from base
union all
select doc_id, 1, n + 2, n + 2, sha256('id: 7' || chr(10) || 'lang: a,b' || chr(10)
  || 'lang (2): say "x"' || chr(10) || '列 4: ') from base""")
def _a10(spark, d):
    text = F.concat(
        F.lit("id,lang,lang,\n"), F.col("doc_id").cast("string"), F.lit(", "), "lang",
        F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('",'), "source",
        F.lit('\n7,"a,b","say ""x""",\n,,,\n\n'))
    rows = data.documents(spark, d).select("doc_id", text.alias("text"))
    blocks, _ = segment.segment_csv(rows)
    return blocks.select("doc_id", "ordinal", "start_line", "end_line",
                         F.sha2("text", 256).alias("text_sha256"))


@R.add("a11_empty_documents", """
select doc_id, 'empty_content' as reject_code from documents where n_chars % 4 = 0""")
def _a11(spark, d):
    rows = data.documents(spark, d).withColumn(
        "text", F.when(F.col("n_chars") % 4 == 0, " \n\t\n").otherwise(F.col("text")))
    return admission.reject_empty(rows, segment.segment_paragraphs(rows))


# The greedy fold, block by block: a paragraph joins the group while at most 400 words result.
PACKED_SQL = "with recursive " + LINES_SQL + r""",
counted as (
  select *, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as n
  from paragraphs),
packed as (
  select doc_id, ordinal, text, n, 0::bigint as group_no, n as total, n <= 400 as open
  from counted where ordinal = 0
  union all
  select c.doc_id, c.ordinal, c.text, c.n,
    p.group_no + case when p.open and p.total + c.n <= 400 then 0 else 1 end,
    case when p.open and p.total + c.n <= 400 then p.total + c.n else c.n end,
    case when p.open and p.total + c.n <= 400 then true else c.n <= 400 end
  from packed p join counted c on c.doc_id = p.doc_id and c.ordinal = p.ordinal + 1)
select doc_id, group_no, min(ordinal) as block_start_ordinal, max(ordinal) as block_end_ordinal,
  sha256(string_agg(text, chr(10) || chr(10) order by ordinal)) as text_sha256
from packed group by 1, 2"""


@R.add("a12_pack_blocks", PACKED_SQL)
def _a12(spark, d):
    blocks = spaced(spark, d).withColumn("blocks", segment.paragraph_blocks(F.col("text")))
    return chunking.pack_blocks(blocks).select(
        "doc_id", "group_no", "block_start_ordinal", "block_end_ordinal",
        F.sha2("text", 256).alias("text_sha256"))


WINDOWS_SQL = r"""tokens as (
  select doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') as t
  from documents),
counted as (
  select doc_id, t, len(t) as n, case when len(t) <= 400 then 1
    else ceil((len(t) - 64) / 336)::bigint end as k from tokens where len(t) > 0),
windows as (
  select doc_id, i as window_index, array_to_string(t[i * 336 + 1:i * 336 + 400], ' ') as content,
    least(400, n - i * 336) as token_count, case when i = 0 then 0 else 64 end as overlap
  from (select *, unnest(range(0, k)) as i from counted))"""


@R.add("a13_window_tokens", "with " + WINDOWS_SQL + """
select doc_id, window_index, token_count, overlap, sha256(content) as content_sha256
from windows""")
def _a13(spark, d):
    return chunking.window_tokens(data.documents(spark, d)).select(
        "doc_id", "window_index", "token_count", "overlap",
        F.sha2("content", 256).alias("content_sha256"))


# One block per document: a document within the budget is kept as it is, a longer one is cut.
@R.add("a14_assemble_chunks", "with " + WINDOWS_SQL + r"""
select w.doc_id, window_index as chunk_index, token_count, overlap as overlap_tokens,
  sha256(case when n <= 400 then regexp_replace(d.text, '^\s+|\s+$', '', 'g') else content end)
    as content_sha256,
  'part > ' || d.source as section, 1 as start_line, len(string_split(d.text, chr(10))) as end_line
from windows w join documents d using (doc_id) join counted c using (doc_id)""")
def _a14(spark, d):
    docs = data.documents(spark, d)
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    block = F.struct(
        F.lit(0).alias("ordinal"), F.lit("paragraph").alias("kind"), trimmed.alias("text"),
        F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"),
        F.array(F.lit("part"), F.col("source")).alias("section_path"),
        F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("int").alias("heading_level"),
        F.lit(None).cast("string").alias("code_language"),
    )
    rows = docs.where(F.length(trimmed) > 0).withColumn("blocks", F.array(block))
    return chunking.chunk_documents(rows).select(
        "doc_id", "chunk_index", "token_count", "overlap_tokens", "content_sha256", "section",
        "start_line", "end_line")


@R.add("a12_a13_a14_chunk_documents")
def _a12c(spark, d):
    blocks = whole_markdown(spark, d).withColumn("blocks", segment.markdown_blocks(F.col("text")))
    return chunking.chunk_documents(blocks, target=120, overlap=20).select(
        "doc_id", "chunk_index", "token_count", "overlap_tokens", "content_sha256", "section",
        "block_start_ordinal", "block_end_ordinal")


@R.add("a15_word_codec", r"""
select doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as words,
  length(text) as chars from documents""")
def _a15(spark, d):
    from askgrid.functions.codecs import CHARS, WORDS

    text = F.col("text")
    return data.documents(spark, d).select(
        "doc_id", F.size(WORDS.encode(text)).alias("words"),
        F.size(CHARS.encode(text)).alias("chars"))


HASHED_SQL = "with vectors as (select doc_id, " + data.VECTOR_SQL.format(q="text") + """ as v
  from documents),
units as (select doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u
  from vectors)"""


@R.add("a16_embed", HASHED_SQL + """
select doc_id, len(u) as dimension,
  list_transform(u, lambda x: round(x::float::double, 4) + 0.0) as components from units""")
def _a16(spark, d):
    out = embedding.embed(data.documents(spark, d), "text", dimension=64)
    return out.select(
        "doc_id", F.size("embedding").alias("dimension"),
        F.transform("embedding", lambda x: F.round(x.cast("double"), 4) + 0.0).alias("components"))


@R.add("a17_validate_vectors", """
select vec_id, case vec_id % 9 when 0 then 'dimension_mismatch' when 1 then 'not_finite'
  when 2 then 'zero_norm' when 3 then 'not_normalized' when 4 then 'missing_vector' end as violation
from embeddings""")
def _a17(spark, d):
    i, e = F.col("vec_id") % 9, F.col("embedding")
    nan = F.lit(float("nan")).cast("float")
    damaged = (
        F.when(i == 0, F.slice(e, 1, 63))
        .when(i == 1, F.concat(F.slice(e, 1, 63), F.array(nan)))
        .when(i == 2, F.transform(e, lambda x: x * F.lit(0.0).cast("float")))
        .when(i == 3, F.transform(e, lambda x: x * F.lit(1.01).cast("float")))
        .when(i == 4, F.lit(None)).otherwise(e)
    )
    rows = table(spark, d, "embeddings").withColumn("embedding", damaged)
    return embedding.validate_vectors(rows, 64).select("vec_id", "violation")


# --- versions -------------------------------------------------------------------------------

def attempts(spark, d):
    return table(spark, d, "documents").select(
        F.col("lang").alias("knowledge_base_id"), F.col("source").alias("source_key"),
        F.col("doc_id").alias("attempt_seq"),
        F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("filename"),
        F.sha2("text", 256).alias("content_sha256"),
        (F.col("doc_id") % 11 != 0).alias("ok"),
        F.lit("embedding_timeout").alias("error_code"),
    )


def stored_documents(spark, d):
    """Documents known before the batch: those of labelled rows, and one key never seen again."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        F.col("lang").alias("knowledge_base_id"),
        F.when(F.col("quality") == 1, F.col("source")).otherwise(
            F.concat("source", F.lit("-old"))).alias("source_key")).distinct()
    return docs.select(
        versions.document_id(F.col("knowledge_base_id"), F.col("source_key")).alias("document_id"),
        "knowledge_base_id", "source_key", F.lit("old").alias("display_name"))


def stored_versions(spark, d):
    """Three versions of each stored document: superseded, failed, active."""
    status = F.array(F.lit("superseded"), F.lit("failed"), F.lit("active"))
    rows = stored_documents(spark, d).select(
        "document_id", "knowledge_base_id", "source_key",
        F.posexplode(status).alias("i", "status"))
    number = (F.col("i") + 1).cast("bigint")
    return rows.select(
        "document_id", "knowledge_base_id", "source_key", number.alias("version_number"),
        versions.version_id(F.col("document_id"), number).alias("version_id"),
        F.sha2(F.concat("source_key", F.col("i").cast("string")), 256).alias("content_sha256"),
        "status", F.when(F.col("status") == "failed", "empty_content").alias("error_code"))


STORED_SQL = """attempts as (
  select lang as knowledge_base_id, source as source_key, doc_id as attempt_seq,
    'file' || doc_id as filename, sha256(text) as content_sha256, doc_id % 11 <> 0 as ok,
    sha256(lang || chr(10) || source) as document_id from documents),
stored_docs as (
  select distinct lang as knowledge_base_id,
    case when quality = 1 then source else source || '-old' end as source_key
  from documents join labels using (doc_id)),
stored_documents as (
  select sha256(knowledge_base_id || chr(10) || source_key) as document_id, *,
    'old' as display_name from stored_docs),
stored_versions as (
  select document_id, knowledge_base_id, source_key, i as version_number,
    sha256(document_id || chr(10) || i) as version_id,
    sha256(source_key || (i - 1)) as content_sha256,
    (['superseded', 'failed', 'active'])[i] as status
  from (select *, unnest([1, 2, 3]) as i from stored_documents)),
numbered as (
  select a.*, case when s.document_id is null then 0 else 3 end + row_number() over (
    partition by a.document_id order by attempt_seq) as version_number
  from attempts a left join stored_documents s using (document_id)),
every_version as (
  select document_id, knowledge_base_id, version_number,
    sha256(document_id || chr(10) || version_number) as version_id, content_sha256,
    case when ok then 'succeeded' else 'failed' end as status from numbered
  union all select document_id, knowledge_base_id, version_number, version_id, content_sha256,
    status from stored_versions),
folded as (
  select * exclude (status), case when status = 'succeeded' and version_number = last then 'active'
    when status = 'succeeded' or (status = 'active' and last is not null) then 'superseded'
    else status end as status
  from (select *, max(case when status = 'succeeded' then version_number end) over (
    partition by document_id) as last from every_version)),
documents_after as (
  select coalesce(s.document_id, a.document_id) as document_id,
    coalesce(s.knowledge_base_id, a.knowledge_base_id) as knowledge_base_id,
    coalesce(s.source_key, a.source_key) as source_key,
    coalesce(a.name, s.display_name) as display_name
  from stored_documents s full join (select document_id, any_value(knowledge_base_id)
      as knowledge_base_id, any_value(source_key) as source_key,
      max_by(filename, attempt_seq) as name from attempts group by 1) a
    on a.document_id = s.document_id)"""


def documents_after(spark, d):
    return versions.upsert_documents(stored_documents(spark, d), attempts(spark, d))


def versions_after(spark, d):
    before = stored_versions(spark, d)
    # The numbered attempts are read twice by the fold; the result is read by several queries.
    numbered = written(versions.assign_versions(before, attempts(spark, d)))
    return versions.apply_attempts(before, numbered)


@R.add("b1_upsert_documents", "with " + STORED_SQL + " select * from documents_after")
def _b1(spark, d):
    return documents_after(spark, d)


@R.add("b2_assign_versions", "with " + STORED_SQL + """
select document_id, attempt_seq, version_number,
  sha256(document_id || chr(10) || version_number) as version_id from numbered""")
def _b2(spark, d):
    out = versions.assign_versions(stored_versions(spark, d), attempts(spark, d))
    return out.select("document_id", "attempt_seq", "version_number", "version_id")


@R.add("b3_apply_attempts", "with " + STORED_SQL + """
select document_id, version_number, version_id, content_sha256, status from folded""")
def _b3(spark, d):
    return versions_after(spark, d).select(
        "document_id", "version_number", "version_id", "content_sha256", "status")


def version_chunks(rows):
    """One to three chunks per version, by its number."""
    return rows.select(
        "version_id", "knowledge_base_id",
        F.explode(F.sequence(F.lit(0), (F.col("version_number") % 3).cast("int"))).alias(
            "chunk_index"))


@R.add("b4_active_chunks", "with " + STORED_SQL + """
select version_id, unnest(range(0, version_number % 3 + 1)) as chunk_index from folded
where status = 'active'""")
def _b4(spark, d):
    after = written(versions_after(spark, d))
    return versions.active_chunks(version_chunks(after), after).select(
        "version_id", "chunk_index")


def _import_batch(spark, d):
    """All documents again under their own hashes; some equal an active version or the attempt
    before them."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    key = F.when(F.coalesce("quality", F.lit(1)) == 1, F.col("source")).otherwise(
        F.concat("source", F.lit("-old")))
    return docs.select(
        "doc_id", F.col("lang").alias("knowledge_base_id"), key.alias("source_key"),
        F.sha2(F.concat(key, F.when(F.col("toxic") == 1, "2").otherwise(
            (F.col("doc_id") % 4).cast("string"))), 256).alias("content_sha256"))


IMPORT_SQL = "with " + STORED_SQL + """,
batch as (
  select doc_id, lang as knowledge_base_id,
    case when coalesce(quality, 1) = 1 then source else source || '-old' end as source_key,
    sha256(case when coalesce(quality, 1) = 1 then source else source || '-old' end ||
      case when toxic = 1 then 2 else doc_id % 4 end) as content_sha256
  from documents left join labels using (doc_id)),
followed as (
  select *, row_number() over w as n, lag(content_sha256) over w as before from batch
  window w as (partition by knowledge_base_id, source_key order by doc_id)),
skipped as (select * from followed b where b.content_sha256 = b.before or b.n = 1 and exists (
  select 1 from stored_versions v
  where v.status = 'active' and v.knowledge_base_id = b.knowledge_base_id
    and v.source_key = b.source_key and v.content_sha256 = b.content_sha256))"""


@R.add("b5_plan_import", IMPORT_SQL + """
select doc_id, doc_id in (select doc_id from skipped) as skipped from batch""")
def _b5(spark, d):
    new, same = versions.plan_import(
        stored_versions(spark, d), _import_batch(spark, d), order="doc_id")
    return new.select("doc_id", F.lit(False).alias("skipped")).unionByName(
        same.select("doc_id", F.lit(True).alias("skipped")))


@R.add("b5_import_report", IMPORT_SQL + """
select count(*) as document_count, count(*) - (select count(*) from skipped) as imported_documents,
  (select count(*) from skipped) as skipped_documents,
  (sum(doc_id % 3 + 1) - coalesce((select sum(doc_id % 3 + 1) from skipped), 0))::bigint
    as imported_chunks from batch""")
def _b5r(spark, d):
    new, same = versions.plan_import(
        stored_versions(spark, d), _import_batch(spark, d), order="doc_id")
    chunks = new.select(F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))))
    return versions.import_report(new, same, chunks)


@R.add("b6_delete_documents", "with " + STORED_SQL + """,
gone as (select document_id from documents_after
  where knowledge_base_id = 'de' or source_key like '%-old')
select 'documents' as kind, count(*) as n from documents_after
  where document_id not in (select document_id from gone)
union all select 'versions', count(*) from folded
  where document_id not in (select document_id from gone)
union all select 'chunks', coalesce(sum(version_number % 3 + 1), 0)::bigint from folded
  where document_id not in (select document_id from gone)""")
def _b6(spark, d):
    docs = documents_after(spark, d)
    keys = docs.where("knowledge_base_id = 'de' or source_key like '%-old'")
    after = written(versions_after(spark, d))
    kept = versions.delete_documents(docs, after, version_chunks(after), keys)
    out = None
    for name, df in zip(("documents", "versions", "chunks"), kept, strict=True):
        part = df.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@R.add("b7_document_status", "with " + STORED_SQL + """,
latest as (select *, row_number() over (partition by document_id order by version_number desc)
  as age from folded),
active as (select document_id, version_id from folded where status = 'active')
select d.document_id, d.display_name, l.version_number, l.status, l.content_sha256,
  l.version_number % 3 + 1 as chunk_count, a.version_id as active_version_id
from documents_after d join latest l on l.document_id = d.document_id and l.age = 1
left join active a on a.document_id = d.document_id""")
def _b7(spark, d):
    after = written(versions_after(spark, d))
    out = versions.document_status(documents_after(spark, d), after, version_chunks(after))
    return out.select("document_id", "display_name", "version_number", "status",
                      "content_sha256", "chunk_count", "active_version_id")


@R.add("b8_incompatible_kbs", "with " + data.KBS_SQL + """
select knowledge_base_id, slug from kbs where embedding_model_revision <> 'r1'""")
def _b8(spark, d):
    return scope.incompatible_kbs(data.knowledge_bases(spark, d), CONFIG).select(
        "knowledge_base_id", "slug")


@R.add("b9_error_codes", """
select event_id, case event_id % 5 when 1 then 'embedding_' || event_type
  when 3 then null when 4 then null else event_type end as code from events""")
def _b9(spark, d):
    i = F.col("event_id") % 5
    raw = (
        F.when(i == 3, "  ").when(i == 4, F.concat("event_type", F.lit("\n"), "event_type"))
        .otherwise(F.concat(F.lit(" "), "event_type", F.lit("\t")))
    )
    return table(spark, d, "events").select(
        "event_id", versions.normalize_error_code(raw, i == 1).alias("code"))


# --- integrity ------------------------------------------------------------------------------

@R.add("b10_check_unique", """
select 'documents' as what, source as k, count(*) as n from documents group by 2 having count(*) > 1
union all select 'messages', conv_id || '/' || turn // 2, count(*) from conversations
  group by 2 having count(*) > 1
union all select 'texts', sha256(text), count(*) from documents group by 2 having count(*) > 1""")
def _b10(spark, d):
    docs = table(spark, d, "documents")
    a = integrity.check_unique(docs, ["source"]).select(
        F.lit("documents").alias("what"), F.col("source").alias("k"), "n")
    turns = table(spark, d, "conversations").select("conv_id", F.expr("turn div 2").alias("pair"))
    b = integrity.check_unique(turns, ["conv_id", "pair"]).select(
        F.lit("messages").alias("what"), F.concat_ws("/", "conv_id", "pair").alias("k"), "n")
    c = integrity.check_unique(docs.select(F.sha2("text", 256).alias("h")), ["h"]).select(
        F.lit("texts").alias("what"), F.col("h").alias("k"), "n")
    return a.unionByName(b).unionByName(c)


@R.add("b11_check_unique_where", "with " + RUNS_SQL + """
select conversation_id, count(*) as n from runs where status = 'completed'
group by 1 having count(*) > 1""")
def _b11(spark, d):
    return integrity.check_unique(runs(spark, d), ["conversation_id"],
                                  F.col("status") == "completed")


@R.add("b12_check_fk", "with " + MESSAGES_SQL + ", " + RUNS_SQL + """
select run_id, conversation_id, count(*) as n from messages m
where not exists (select 1 from runs r where r.run_id = m.run_id
  and r.conversation_id = m.conversation_id and r.status <> 'failed')
group by 1, 2""")
def _b12(spark, d):
    parent = runs(spark, d).where("status <> 'failed'")
    return integrity.check_fk(messages(spark, d), parent,
                              {"run_id": "run_id", "conversation_id": "conversation_id"})


@R.add("b13_check_rows", """
with r as (select event_id as run_id, event_id % 6 as s, event_id % 7 as f, event_id % 5 as m,
    event_id % 11 as e, value, user_id from events),
t as (select *, (['running', 'completed', 'no_context', 'clarification', 'failed', 'odd'])[s + 1]
    as status, f = 0 as unfinished,
    case s when 1 then 'knowledge_base' when 2 then 'knowledge_base' when 3 then 'clarification'
      else case when e = 0 then 'knowledge_base' end end as route from r)
select run_id, 'status_allowed' as rule from t where status = 'odd'
union all select run_id, 'finished_at_matches_status' from t
  where (status = 'running') <> unfinished
union all select run_id, 'completed_model_result_present' from t
  where status in ('completed', 'clarification') and m = 0
union all select run_id, 'intent_route_matches_status' from t
  where status in ('running', 'failed', 'odd') and route is not null
union all select run_id, 'input_tokens_nonnegative' from t where value < 1
union all select run_id, 'error_code_matches_status' from t
  where (status = 'failed') <> (e = 1)""")
def _b13(spark, d):
    i = F.col("event_id")
    states = ["running", "completed", "no_context", "clarification", "failed", "odd"]
    status = F.element_at(F.array(*[F.lit(s) for s in states]), (i % 6 + 1).cast("int"))
    rows = table(spark, d, "events").select(
        i.alias("run_id"), status.alias("status"),
        F.when(i % 7 != 0, F.col("ts")).alias("finished_at"),
        F.when(i % 5 != 0, "m1").otherwise(" ").alias("model_id"),
        F.lit("stop").alias("finish_reason"),
        F.when(i % 6 == 1, "knowledge_base").when(i % 6 == 2, "knowledge_base")
        .when(i % 6 == 3, "clarification").when(i % 11 == 0, "knowledge_base").alias(
            "intent_route"),
        F.when(F.col("value") < 1, -1).otherwise(1).alias("input_tokens"),
        F.lit(None).cast("int").alias("output_tokens"),
        F.when(i % 11 == 1, "timeout").alias("error_code"),
    )
    return integrity.check_rows(rows, ["run_id"], integrity.run_rules())


@R.add("b14_normalize_fields", """
select doc_id, source || '-' || lang as slug, source as source_key,
  case when doc_id % 4 = 0 then '..' else 'f' || doc_id || '.txt' end as filename,
  'text/plain' as media_type, case when doc_id % 4 = 0 then 'filename' else '' end as bad
from documents where doc_id % 3 <> 0
union all
select doc_id, '-' || source, source, case when doc_id % 4 = 0 then '..' else
  'f' || doc_id || '.txt' end, 'text/plain',
  case when doc_id % 4 = 0 then 'slug,filename' else 'slug' end
from documents where doc_id % 3 = 0""")
def _b14(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id",
        F.when(i % 3 == 0, F.concat(F.lit("-"), "source")).otherwise(
            F.concat(F.lit(" "), F.upper("source"), F.lit("-"), "lang", F.lit(" "))).alias("slug"),
        F.concat(F.lit("\t"), "source", F.lit(" ")).alias("source_key"),
        F.when(i % 4 == 0, "a/..").otherwise(
            F.concat(F.lit(" C:\\dir/f"), i.cast("string"), F.lit(".txt "))).alias("filename"),
        F.lit(" Text/PLAIN ; q=1").alias("media_type"),
    )
    out = integrity.normalize_fields(rows)
    return out.select("doc_id", "slug", "source_key", "filename", "media_type",
                      F.array_join("field_violations", ",").alias("bad"))


# --- corpus folders and evaluation sets -------------------------------------------------------

CATEGORIES = ("guides", "faq", "policy", "news")


def corpus_files(spark, d):
    """Pages as files of a corpus folder: four categories (one of them empty) and extra files."""
    i = F.col("page_id")
    folder = F.element_at(F.array(*[F.lit(c) for c in ("guides", "faq", "policy", "_meta")]),
                          (i % 4 + 1).cast("int"))
    return table(spark, d, "pages").select(
        F.concat(F.lit("file:/x/root/root/"), folder, F.lit("/"),
                 F.when(i % 3 == 0, "deep/").otherwise(""), i.cast("string"), F.lit(".md"))
        .alias("path"),
        F.encode("html", "UTF-8").alias("content"))


FILES_SQL = """with files as (
  select (['guides', 'faq', 'policy', '_meta'])[page_id % 4 + 1] as folder, html,
    case when page_id % 3 = 0 then 'deep/' else '' end || page_id || '.md' as rest from pages),
named as (select folder as category, folder || '/' || rest as relative_path,
  split_part(rest, '/', -1) as filename, sha256(html) as content_sha256 from files)"""


@R.add("a1_corpus_files", FILES_SQL + " select * from named")
def _a1(spark, d):
    return corpus.corpus_files(corpus_files(spark, d), "file:/x/root/root").drop("content")


@R.add("a1_corpus_documents", FILES_SQL + """
select case when relative_path = '_meta/7.md' then 'MAPPING' end as document_id,
  case when relative_path = '_meta/7.md' then 'guides' else category end as category,
  relative_path from named where category <> '_meta' or relative_path = '_meta/7.md'""")
def _a1d(spark, d):
    files = corpus.corpus_files(corpus_files(spark, d), "file:/x/root/root")
    found, _ = corpus.corpus_documents(files, CATEGORIES, {"_meta/7.md": ("MAPPING", "guides")})
    return found.select("document_id", "category", "relative_path")


@R.add("a1_corpus_problems", FILES_SQL + """
select 'category_missing' as code, c as name from (select unnest(['guides', 'faq', 'policy',
  'news']) as c) where c not in (select category from named)
union all select 'special_missing', s from (select unnest(['_meta/7.md', '_meta/none.md']) as s)
  where s not in (select relative_path from named)""")
def _a1p(spark, d):
    files = corpus.corpus_files(corpus_files(spark, d), "file:/x/root/root")
    _, problems = corpus.corpus_documents(
        files, CATEGORIES, {"_meta/7.md": ("MAPPING", "guides"), "_meta/none.md": ("N", "faq")})
    return problems


@R.add("a2_evaluation_lines", """
with numbered as (
  select conv_id || '-' || turn as query_id, text, (conv_id + turn) % 5 as kind
  from conversations)
select case when kind > 1 then query_id end as query_id, case when kind > 1 then sha256(text) end
    as query_sha256, case when kind > 1 then kind = 4 end as requires_tool,
  case when kind > 1 then len(case when kind = 3 then ['a', 'b'] else [] end) end as nice,
  case kind when 0 then 'blank_line' when 1 then 'malformed_line' end as reject_code
from numbered""")
def _a2(spark, d):
    """Messages as evaluation lines; a fifth is blank, another fifth is cut short."""
    kind = (F.col("conv_id") + F.col("turn")) % 5
    sample = F.to_json(F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"),
        F.lit(True).alias("requires_rag"),
        F.when(kind == 4, True).alias("requires_tool"),
        F.when(kind == 3, F.array(F.lit("a"), F.lit("b"))).alias("expected_doc_ids_nice")))
    lines = table(spark, d, "conversations").select(
        F.when(kind == 0, F.repeat(F.lit(" "), (F.col("turn") % 3).cast("int")))
        .when(kind == 1, F.concat(sample, F.lit("x{"))).otherwise(sample).alias("line"))
    lines = lines.withColumn("line", F.when(
        F.endswith("line", F.lit("x{")), F.concat(F.lit("{"), "line")).otherwise(F.col("line")))
    samples, rejects = corpus.parse_eval_lines(lines)
    return samples.select(
        "query_id", F.sha2("query", 256).alias("query_sha256"), "requires_tool",
        F.size("expected_doc_ids_nice").alias("nice"),
        F.lit(None).cast("string").alias("reject_code")).unionByName(rejects.select(
            F.lit(None).cast("string").alias("query_id"),
            F.lit(None).cast("string").alias("query_sha256"),
            F.lit(None).cast("boolean").alias("requires_tool"),
            F.lit(None).cast("int").alias("nice"), "reject_code"))
