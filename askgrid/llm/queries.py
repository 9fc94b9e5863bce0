"""The registered queries of this package over the given tables, with SQL where it can follow."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm import conversation_repair, decontaminate, fill_middle, fingerprints, html_text
from askgrid.llm import mixing, near_dedup, packing, quality, segment_search, warc
from askgrid.llm import token_counts as counts
from askgrid.llm import token_files as files
from askgrid.plans.shared import shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- mixing -------------------------------------------------------------------------------------

#: Sources fall into domains by their number; the tree is domain, language, source.
DOMAINS = ("web", "books", "code")
MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS: dict[tuple, int] = {
    ("web",): 3, ("books",): 5, ("code",): 2,
    **{(d, lang): w for d in DOMAINS for lang, w in (("en", 2), ("de", 3), ("fr", 1), ("es", 2))},
    ("web", "en", "src0"): 2, ("books", "de", "src1"): 4, ("code", "en", "src2"): 0,
}


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "[0-9]+", 0)
    place = F.when(number == "", 0).otherwise(F.expr("try_cast(substr(regexp_extract("
        "coalesce(source, ''), '[0-9]+', 0), 1, 15) as bigint)") % len(DOMAINS))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), place.cast("int") + 1)


def with_domain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", domain_of(F.col("source")))


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents mixed to target weights, at most twice each."""
    docs = with_domain(_table(spark, folder, "documents"))
    words = mixing.count_words(F.col("text"))
    return mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS).select(
        "doc_id", *MIX_LEVELS, "epoch", words.alias("n_tokens"))


def _op1_sql() -> str:
    """The same budgets in SQL: one block of windows per level of the tree."""
    weights = ", ".join(
        "(" + ", ".join(f"'{p}'" for p in [*path, *[""] * (3 - len(path))]) + f", {w})"
        for path, w in MIX_WEIGHTS.items())
    parts = [f"""with w(d, l, s, weight) as (values {weights}),
docs as (
  select doc_id, lang, source, (['web', 'books', 'code'])[
      case when regexp_extract(coalesce(source, ''), '[0-9]+') = '' then 0
        else regexp_extract(source, '[0-9]+')::bigint % 3 end + 1] as domain,
    len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::bigint
      as n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens)::hugeint as tokens from docs group by all),
g0 as (select floor(sum(tokens)::double * {mixing.BUDGET_SHARE})::hugeint as allocated from leaf)
"""]
    for depth in (1, 2, 3):
        keys = list(MIX_LEVELS[:depth])
        padded = [*[f"n.{k}" for k in keys], *["''"] * (3 - depth)]
        parent = f"partition by {', '.join(keys[:-1])}" if depth > 1 else ""
        link = " and ".join(f"n.{k} is not distinct from p.{k}" for k in keys[:-1]) or "true"
        order = (f"{parent} order by case when weight > 0 then capacity::double / weight end "
                 f"nulls last, {keys[-1]} nulls first")
        parts.append(f"""n{depth} as (
  select n.*, p.allocated as budget, coalesce(w.weight, 1)::hugeint as weight
  from (select {', '.join(keys)}, sum(tokens) * {mixing.MAX_EPOCHS} as capacity
        from leaf group by all) n
  join g{depth - 1} p on {link}
  left join w on w.d = {padded[0]} and w.l = {padded[1]} and w.s = {padded[2]}),
a{depth} as (
  select *, coalesce(sum(capacity) over ({order}
      rows between unbounded preceding and 1 preceding), 0) as used,
    sum(weight) over ({order} rows between current row and unbounded following) as rest_weight,
    row_number() over ({order}) as place
  from n{depth}),
b{depth} as (
  select *, weight > 0 and capacity * rest_weight <= weight * (budget - used) as is_full
  from a{depth}),
c{depth} as (
  select *, min(case when not is_full then place end) over ({parent}) as first_open from b{depth}),
d{depth} as (
  select *, max(case when place = first_open then budget - used end) over ({parent}) as open_left,
    max(case when place = first_open then rest_weight end) over ({parent}) as open_weight
  from c{depth}),
g{depth} as (
  select {', '.join(keys)}, case when is_full then capacity when weight > 0
    then least(capacity, (weight * open_left) // open_weight) else 0 end as allocated
  from d{depth})
""")
    parts.append(f"""cuts as (
  select l.*, allocated // tokens as epochs, allocated % tokens as rest
  from leaf l join g3 g on l.domain = g.domain and l.lang is not distinct from g.lang
    and l.source is not distinct from g.source where tokens > 0),
keyed as (
  select d.*, epochs, rest, md5('{mixing.SEED}|' || epochs || '|' || coalesce(doc_id::varchar,
    'null')) as key
  from docs d join cuts c on d.domain = c.domain and d.lang is not distinct from c.lang
    and d.source is not distinct from c.source),
taken as (
  select *, epochs + case when rest > 0 and sum(n_tokens) over (
      partition by domain, lang, source order by key) <= rest then 1 else 0 end as times
  from keyed)
select doc_id, domain, lang, source, unnest(range(0, times::bigint))::int as epoch, n_tokens
from taken""")
    return ",\n".join(parts)


# --- other operators ----------------------------------------------------------------------------

def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near-duplicate documents of every document."""
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every document."""
    return quality.quality_scores(_table(spark, folder, "documents"),
                                  _table(spark, folder, "labels"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary."""
    return counts.token_counts(_table(spark, folder, "documents"),
                               public_tokenizers.path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, folder, "documents"),
                                  public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as ORC token files, read back."""
    path = shared_folder(spark)
    files.write_token_files(_table(spark, folder, "documents"), path,
                            public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return files.token_file_report(spark, path)


def op7_segment_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best vectors of every twentieth one."""
    return segment_search.topk_embeddings(_table(spark, folder, "embeddings"))


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x:
    x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, x.vec_id,
    list_inner_product(q.v, x.v)::bigint as score
  from v q join v x on q.vec_id <> x.vec_id and len(q.v) = len(x.v)
  where q.vec_id % 20 = 0),
r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int
    as rank, vec_id, score from s)
select * from r where rank <= 20"""


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_edits(_table(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC archives, read back."""
    path = shared_folder(spark)
    warc.write_warc(_table(spark, folder, "pages"), path)
    return warc.read_warc(spark, path)


OP9_SQL = """
with p as (
  select page_id, url, coalesce(html, '') as html from pages),
d as (
  select page_id, url, octet_length(encode(html))::bigint as payload_bytes,
    sha1(html) as payload_digest from p),
g as (
  select payload_digest, max(page_id) as keeper from d where payload_bytes >= 1000 group by 1)
select page_id, url, payload_bytes, payload_digest,
  case when keeper is null or keeper = page_id then 'response' else 'revisit' end as record_type,
  case when keeper is null or keeper = page_id then null else keeper end as refers_to,
  true as valid
from d left join g using (payload_digest)"""


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The visible text of all pages."""
    return html_text.extract_text(_table(spark, folder, "pages"))


# --- conversations ------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults drawn from the place of each row; nulls become one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" "))
                             for c in ("conv_id", "turn")])
    text = F.coalesce("text", F.lit(" "))
    return (
        rows.withColumn("fault", F.crc32(key) % 20).where("fault <> 0")
        .select(
            "conv_id", "turn",
            F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
            .alias("role"),
            F.when(F.col("fault") == 1, "").when(
                F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
            .alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
            .alias("copy"))
        .drop("copy"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    rows = _table(spark, folder, "conversations")
    plan = conversation_repair.plan_repairs(damaged(rows))
    return conversation_repair.repair_report(plan, rows)


def _op11_sql() -> str:
    """The same edits by a recursion over rows that carries cost, letters and text per state."""
    cost = {"D": conversation_repair.DELETE, "I": conversation_repair.INSERT,
            "R": conversation_repair.REROLE, "K": conversation_repair.KEEP}
    order = "turn nulls first, role, sha256(text), copy"
    states = "esua"  # nothing, system, user, assistant

    def grown(state: str, letter: str, then: str, role: str, text: str, extra: str = "0") -> str:
        line = f"{role} || ':' || {text}"
        joined = f"{state}.l || case when {state}.n > 0 then chr(10) else '' end || {line}"
        return (f"{{'c': {state}.c + {cost[letter]} + {extra}, 'a': {state}.a || '{letter}', "
                f"'n': {state}.n + 1, 'l': {joined}}}")

    far = "{'c': 1000000000, 'a': '', 'n': 0, 'l': ''}"

    def inserted(prefix: str) -> str:
        """States after at most one insertion: two in a row never pay."""
        return ", ".join([
            f"{prefix}e as e, {prefix}s as s",
            f"least({prefix}u, {grown(prefix + 'e', 'I', 'u', QUOTED[0], EMPTY)}, "
            f"{grown(prefix + 's', 'I', 'u', QUOTED[0], EMPTY)}, "
            f"{grown(prefix + 'a', 'I', 'u', QUOTED[0], EMPTY)}) as u",
            f"least({prefix}a, {grown(prefix + 'u', 'I', 'a', QUOTED[1], EMPTY)}) as a"])

    QUOTED, EMPTY = ("'user'", "'assistant'"), "''"
    gone = {q: f"{{'c': i.{q}.c + {cost['D']}, 'a': i.{q}.a || 'D', 'n': i.{q}.n, 'l': i.{q}.l}}"
            for q in states}
    cut = "r.cut::int"

    def kept(state: str, initial: str) -> str:
        way = grown(f"i.{state}", "K", "", "r.role", "r.text", cut)
        return f"case when r.dead or left(r.role, 1) <> '{initial}' then {far} else {way} end"

    def turned(state: str, role: str) -> str:
        way = grown(f"i.{state}", "R", "", role, "r.text", cut)
        return f"case when r.dead then {far} else {way} end"

    to_user = ", ".join([kept(q, "u") for q in "esa"] + [turned(q, QUOTED[0]) for q in "esa"])
    return rf"""
with recursive c0 as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
  from conversations),
crc_table as (
  select i, list_reduce(list_prepend(i::bigint, range(8)), lambda x, y:
    xor(x >> 1, (x & 1) * 3988292384)) as t from range(256) g(i)),
crc_list as (select list(t order by i) as ts from crc_table),
c1 as (
  select conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda x:
      ascii(x)::bigint)),
    lambda x, y: xor(x >> 8, ts[(xor(x, y) & 255) + 1]))) % 20 as fault
  from c0, crc_list),
d as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end
      as text, unnest(range(case when fault = 3 then 2 else 1 end)) as copy
  from c1 where fault <> 0),
n as (select *, row_number() over (partition by conv_id order by {order}) as i from d),
f as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
    i > min(i) over (partition by conv_id, role, text) as copied,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut,
    lag(left(role, 1)) over (partition by conv_id order by i) as earlier
  from n),
r as materialized (select *, blank or copied as dead from f),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (blank) as blank, count(*) filter (copied and not blank) as duplicate,
    count(*) filter (cut and not dead) as truncated,
    count(*) filter (i > 1 and earlier || left(role, 1) not in ('su', 'ua', 'au')) as illegal,
    max(i) as rows
  from r group by 1),
walk as (
  select conv_id, 0::bigint as step, {{'c': 0, 'a': '', 'n': 0, 'l': ''}} as e, {far} as s,
    {far} as u, {far} as a from counts
  union all
  select i.conv_id, i.step + 1, {gone['e']}, least({gone['s']}, {kept('e', 's')}),
    least({gone['u']}, {to_user}), least({gone['a']}, {kept('u', 'a')}, {turned('u', QUOTED[1])})
  from (select conv_id, step, {inserted('')} from walk) i
  join r on r.conv_id is not distinct from i.conv_id and r.i = i.step + 1),
ended as (
  select w.conv_id, least(e, least(w.a, {grown('w.u', 'I', 'a', QUOTED[1], EMPTY)})) as best
  from walk w join counts c on c.conv_id is not distinct from w.conv_id and w.step = c.rows)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank,
  coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost,
  coalesce(best.a, '') as audit, sha256(coalesce(best.l, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join ended e on e.conv_id is not distinct from o.conv_id"""


# --- evaluation leaks and training forms ----------------------------------------------------------

def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie inside passages of the benchmark."""
    found = decontaminate.find_contamination(_table(spark, folder, "documents"),
                                             _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = rf"""
with words as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
frames as (
  select distinct item, least(len(w), {decontaminate.WIDTH}) as size,
    array_to_string(w[i:i + size - 1], ' ') as frame
  from (select item, w, unnest(range(1, greatest(len(w) - {decontaminate.WIDTH}, 0) + 2)) as i
        from items where len(w) > 0)),
places as (
  select r, i, size, array_to_string(w[i:i + size - 1], ' ') as frame
  from (select r, w, unnest(range(1, len(w) + 1)) as i from words),
    (select distinct size from frames)
  where i + size - 1 <= len(w)),
hits as (select r, i, size, item from places join frames using (size, frame)),
found as (
  select r, count(distinct item) as n_items,
    sha256(string_agg(distinct item, ',' order by item)) as items_sha256 from hits group by 1),
covered as (
  select r, count(distinct place) as n_hit
  from (select r, unnest(range(i, i + size)) as place from (select distinct r, i, size from hits))
  group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  n_hit is not null as contaminated
from words left join found using (r) left join covered using (r)"""


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a fill-in-the-middle example, and the text rebuilt from it."""
    made = fill_middle.fill_in_middle(_table(spark, folder, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = rf"""
with t as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w,
    sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (
  select *, len(w)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
        or h3 % 100 >= {fill_middle.PLAIN_FROM} then 'plain'
      when h4 % 100 < {fill_middle.SUFFIX_FIRST_BELOW} then 'spm' else 'psm' end as form from h),
p as (
  select *, array_to_string(w[1:a], '') as prefix, array_to_string(w[a + 1:b], '') as middle,
    array_to_string(w[b + 1:], '') as suffix from c)
select doc_id, n, form,
  case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text
    when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_segment_search": op7_segment_search,
    "op8_fingerprints": op8_fingerprints,
    "op9_warc": op9_warc,
    "op10_html_text": op10_html_text,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_decontamination": op12_decontamination,
    "op13_fill_middle": op13_fill_middle,
}

SQL: dict[str, str] = {
    "op1_mixing": _op1_sql(),
    "op7_segment_search": OP7_SQL,
    "op9_warc": OP9_SQL,
    "op11_conversation_repair": _op11_sql(),
    "op12_decontamination": OP12_SQL,
    "op13_fill_middle": OP13_SQL,
}
