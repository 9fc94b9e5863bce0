import random

import pytest
from pyspark.sql import functions as F

from askgrid.functions.codecs import CHARS, WORDS, codec_mismatch, user_codec
from askgrid.operators import chunking, embedding, segment
from conftest import rows


def as_blocks(spark, *documents):
    data = [
        (d, [(i, kind, text, i + 1, i + 1, list(path), None, 1 if kind == "heading" else None,
              None) for i, (kind, text, path) in enumerate(items)])
        for d, items in enumerate(documents)
    ]
    return spark.createDataFrame(data, f"doc_id long, blocks array<{segment.BLOCK}>")


def greedy(items, target, count):
    """Plain loop over blocks giving groups of block positions."""
    groups, pending = [], []

    def text(ids):
        return "\n\n".join(items[i][1] for i in ids)

    for i, (kind, body, path) in enumerate(items):
        if pending and (kind == "heading" or path != items[pending[-1]][2]):
            groups.append(pending)
            pending = []
        if not pending:
            if count(body) <= target:
                pending = [i]
            else:
                groups.append([i])
        elif count(text([*pending, i])) <= target:
            pending.append(i)
        elif len(pending) == 1 and items[pending[0]][0] == "heading":
            groups.append([*pending, i])
            pending = []
        else:
            groups.append(pending)
            pending = [i] if count(body) <= target else []
            if not pending:
                groups.append([i])
    return groups + ([pending] if pending else [])


def random_document(rng):
    path, items = ("a",), []
    for _ in range(rng.randrange(1, 14)):
        if rng.random() < 0.25:
            path = (f"h{rng.randrange(4)}",)
            items.append(("heading", " ".join(["h"] * rng.randrange(1, 9)), path))
        else:
            items.append(("paragraph", " ".join("w" * rng.randrange(1, 4)
                                                for _ in range(rng.randrange(1, 15))), path))
    return items


@pytest.mark.parametrize("codec", ["words", "chars", "user"])
def test_packing_matches_plain_loop(spark, codec):
    rng = random.Random(9)
    documents = [random_document(rng) for _ in range(40)]
    target = 30 if codec == "chars" else 10
    used = user_codec("m", "1", lambda ts: [t.split() for t in ts], " ") if codec == "user" else codec
    count = len if codec == "chars" else (lambda t: len(t.split()))
    got = rows(chunking.pack_blocks(as_blocks(spark, *documents), target=target, codec=used),
               "doc_id", "group_no", "block_start_ordinal", "block_end_ordinal")
    want = [(d, n, g[0], g[-1]) for d, items in enumerate(documents)
            for n, g in enumerate(greedy(items, target, count))]
    assert got == sorted(want, key=repr)


def test_char_windows_overlap(spark):
    df = as_blocks(spark, [("paragraph", "abcdefghijklmnopqrstuv", ())])
    out = chunking.chunk_documents(df, target=10, overlap=3, codec="chars").orderBy("chunk_index")
    assert [(r["content"], r["token_count"], r["overlap_tokens"]) for r in out.collect()] == [
        ("abcdefghij", 10, 0), ("hijklmnopq", 10, 3), ("opqrstuv", 8, 3)]


def test_windows_cover_every_token_once_apart_from_overlap(spark):
    for n in (0, 1, 9, 10, 11, 17, 18, 100):
        text = " ".join(f"t{i}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        found = chunking.window_tokens(df, target=10, overlap=3).orderBy("window_index").collect()
        tokens = []
        for r in found:
            words = r["content"].split()
            assert len(words) == r["token_count"] <= 10
            tokens += words[r["overlap"]:]
        assert tokens == text.split()


def test_chunk_index_section_and_user_codec_agree(spark):
    rng = random.Random(3)
    documents = [random_document(rng) for _ in range(10)]
    columns = ["doc_id", "chunk_index", "content", "token_count", "overlap_tokens", "section",
               "content_sha256", "block_start_ordinal", "block_end_ordinal"]
    df = as_blocks(spark, *documents)
    plain = rows(chunking.chunk_documents(df, target=6, overlap=2), *columns)
    mine = user_codec("m", "1", lambda ts: [t.split() for t in ts], " ")
    assert rows(chunking.chunk_documents(df, target=6, overlap=2, codec=mine), *columns) == plain
    by_doc = {}
    for r in plain:
        by_doc.setdefault(r[0], []).append(r[1])
    assert all(sorted(v) == list(range(len(v))) for v in by_doc.values())


def test_section_label_is_cut(spark):
    df = spark.createDataFrame([(["a" * 300, "b" * 300],), ([],)], "p array<string>")
    got = [r[0] for r in df.select(chunking.section_label(F.col("p"))).collect()]
    assert got == [("a" * 300 + " > " + "b" * 300)[:500], None]


def test_bad_window_parameters(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        chunking.window_tokens(df, target=5, overlap=5)


def test_codec_identity(spark):
    df = spark.createDataFrame([("words", "1"), ("other", "1"), (None, "1")], "m string, r string")
    got = [r[0] for r in df.select(codec_mismatch(WORDS, F.col("m"), F.col("r"))).collect()]
    assert got == [False, True, True]
    assert CHARS.joiner == ""


def test_embedding_port_loads_once_per_worker_and_validates(spark):
    import numpy as np

    def load():
        return lambda texts: np.array([[len(t), 0.0] for t in texts], dtype=float)

    df = spark.createDataFrame([(1, "a"), (2, "abc")], "doc_id long, content string")
    out = embedding.validate_vectors(embedding.embed(df, load=load), 2)
    assert rows(out, "doc_id", "violation") == [(1, None), (2, "not_normalized")]
    counts = embedding.vector_count_violations(df, df.where("doc_id = 1"), "doc_id")
    assert rows(counts) == [(2, 1, 0)]


def test_groups_within_the_budget_are_counted_not_encoded_again(spark):
    from askgrid.functions.codecs import Codec

    def encode(text):
        joined = F.raise_error(F.lit("encoded again")).cast("array<string>")
        return F.when(text.contains("\n\n"), joined).otherwise(WORDS.encode(text))

    mine = Codec("w", "1", encode, " ", gap=0)
    documents = [[("paragraph", "a b", ()), ("paragraph", "c", ()),
                  ("paragraph", "d e f g h i j", ())]]
    out = chunking.chunk_documents(as_blocks(spark, *documents), target=4, overlap=1, codec=mine)
    assert rows(out, "content", "token_count", "overlap_tokens") == [
        ("a b\n\nc", 3, 0), ("d e f g", 4, 0), ("g h i j", 4, 1)]


def test_blanks_trimming_and_words_agree_on_all_characters(spark):
    from askgrid.functions.text import WHITE, WHITE_CHARS, is_blank, strip, strip_line

    found = spark.range(1, 0x10000).where("id not between 55296 and 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    c, edged = F.col("c"), F.concat("c", F.lit("a b"), "c")
    white = c.isin(list(WHITE_CHARS))
    odd = (c.rlike(f"^{WHITE}$") != white) | (is_blank(c) != white) | (
        strip_line(edged) != strip(edged)) | (strip_line(c) != strip(c))
    assert rows(found.where(odd)) == []


def test_word_and_character_counts_equal_the_sql_on_odd_texts(spark, tmp_path):
    import duckdb
    from askgrid.workload import ingest

    texts = ["", None, " ", "\n", "a", " a  b\r\n\tc\f", "é \U0001f600\U0001f600", "e\u0301\u200bx",
             "x\0y"]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = rows(ingest.R.queries["a15_word_codec"](spark, str(tmp_path)), "doc_id", "words", "chars")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    want = con.execute(ingest.R.sql["a15_word_codec"]).fetchall()
    assert got == sorted(want)
    assert got[:3] == [(0, 0, 0), (1, None, None), (2, 0, 1)]
