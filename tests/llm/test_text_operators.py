"""Encoding, token counts, token files, packing, HTML and WARC against the libraries themselves."""

import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from askgrid.llm import packing, queries, token_counts, token_files, warc
from askgrid.llm.encoding import Encoder, slices
from askgrid.llm.html_text import html_to_text
from askgrid.plans.shared import shared_folder

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"
ODD = ["", " ", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "a  b\x1c c  \n\n d", "it's 'r 're, x.'s!!",
       "  lead", "trail  \n", "é ́x .́", "　 漢字。 漢 字", "A,B.c!d?*e" * 3, "\x85 a", "İstanbul ŉ", None]


def random_text(rng, n):
    return "".join(rng.choice(["a", "B", "é", " ", "  ", "\n", ".", ",", "'s", "1", "漢", "́", "\xa0",
                               "<|endoftext|>", "word", "!", "\t"]) for _ in range(n))


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_cached_encoding_equals_the_library(file):
    rng = random.Random(5)
    texts = ODD + [random_text(rng, rng.randrange(60)) for _ in range(400)]
    library = Tokenizer.from_file(file)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = Encoder(file).ids(pa.array(texts))
    assert [list(got.ids[a:b]) for a, b in zip(got.offsets, got.offsets[1:])] == want
    assert list(Encoder(file, counts_only=True).counts(pa.array(texts))) == [len(w) for w in want]
    assert list(Encoder(file).counts(pa.array([], pa.string()))) == []


def test_slices_cover_everything_in_order():
    texts = pa.array(["a" * 10, None, "b" * 50, "", "c"])
    assert sum(n for _, n in slices(texts, 12)) == 5
    assert [s for s, _ in slices(texts, 12)] == sorted({s for s, _ in slices(texts, 12)})


def frame(spark, rows, schema="doc_id bigint, text string, n_tokens int, part string"):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], schema)


@pytest.mark.parametrize("overlap", [8, 64])
def test_token_counts_with_and_without_alignment(spark, overlap):
    rng = random.Random(3)
    texts = ["a" * 5000 + " " + "b c " * 900, "x  y\n\n<|endoftext|>" * 700, None, "",
             "é" * 3000 + "漢字。" * 900, "a" * 5000 + " " + "b c " * 900, " " * 2000 + "z",
             random_text(rng, 3000)]
    docs = frame(spark, [(i if i != 5 else None, t) for i, t in enumerate(texts)])
    library = Tokenizer.from_file(BYTE)
    got = token_counts.token_counts(docs, BYTE, chunk=200, overlap=overlap, huge=300).collect()
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False)))
                  for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert sum(r.doc_id is None for r in got) == 1
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(docs.limit(0), BYTE).count() == 0


def test_op4_over_the_given_documents(spark):
    library = Tokenizer.from_file(BYTE)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, FOLDER).collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False)) for k, t in docs.items()}


def test_token_files_round_trip(spark):
    rows = [(3, "the End"), (1, None), (2, "a b"), (2, "a b"), (None, "x"), (9, "")]
    path = shared_folder(spark)
    token_files.write_token_files(frame(spark, rows), path, WORD)
    got = sorted(token_files.token_file_report(spark, path).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(WORD), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(order)
    for r, (doc, text) in zip(got, order):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, ids.size)
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
        at += ids.size
    found = token_files.find_documents(spark, path, queries.F.col("doc_id") == 3)
    assert [list(r.ids) for r in found.collect()] == [
        library.encode("the End", add_special_tokens=False).ids + [1]]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in \
        found._jdf.queryExecution().toString()
    empty = shared_folder(spark)
    token_files.write_token_files(frame(spark, rows).limit(0), empty, WORD)
    assert token_files.token_file_report(spark, empty).count() == 0


def test_patterns_hold_every_piece_and_come_near_the_bound():
    rng = np.random.default_rng(0)
    for n in (1, 50, 20_000):
        histogram = {}
        for c in np.clip(rng.lognormal(3.5, 1.1, n).astype(int), 1, 256):
            histogram[int(c)] = histogram.get(int(c), 0) + 1
        plan = packing.plan_sequences(histogram, 256)
        held = dict.fromkeys(histogram, 0)
        for counts, times in plan:
            assert sum(c * k for c, k in counts.items()) <= 256
            for c, k in counts.items():
                held[c] += k * times
        assert all(held[c] >= k for c, k in histogram.items())
        bound = sum(c * k for c, k in histogram.items()) / 256
        assert sum(t for _, t in plan) <= 1.01 * bound + 2
    assert packing.plan_sequences({}, 256) == []


def check_packed(rows, texts):
    library, by_doc, by_sequence = Tokenizer.from_file(WORD), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == ids.size
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == ids.size
    filled = padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        assert {r.padded_length for r in pieces} == {at if at & (at - 1) == 0 else 4096}
        filled, padded = filled + at, padded + pieces[0].padded_length
    return filled / padded


def test_packing(spark):
    texts = {i: "word " * n for i, n in enumerate([0, 1, 4094, 4095, 4096, 9000, 100, 7, 2000])}
    texts[50] = None
    docs = frame(spark, list(texts.items()), "doc_id bigint, text string, class int, part string")
    check_packed(packing.pack_documents(docs, WORD).collect(), texts)
    twice = packing.pack_documents(frame(spark, [(1, "a b"), (1, "a b"), (None, "c")]), WORD)
    assert sorted((r.doc_id or -1, r.length) for r in twice.collect()) == [(-1, 2), (1, 3), (1, 3)]
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


@pytest.mark.parametrize("length", [3, 17, 33, 70, 300])
def test_short_documents_fill_their_sequences(spark, length):
    texts = {i: "word " * (length - 1) for i in range(2_000)}
    docs = frame(spark, list(texts.items()))
    rows = packing.pack_documents(docs, WORD).collect()
    check_packed(rows, texts)
    assert len({r.sequence_id for r in rows}) == -(-2_000 // (4096 // length))  # no fewer can do


def test_op5_over_the_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert check_packed(queries.op5_packing(spark, FOLDER).collect(), texts) > 0.95


class Words(HTMLParser):
    """Visible words by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.words, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_html_keeps_all_visible_words(spark):
    got = {r.page_id: r.text for r in queries.op10_html_text(spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        parser = Words()
        parser.feed(page.html)
        assert "".join(re.findall(r"[^\s-]", got[page.page_id])) == \
            "".join(re.findall(r"[^\s-]", "".join(parser.words)))


def test_html_layout():
    assert html_to_text(
        "<title>x</title><p>Hi <b>there</b>,\n you<p>Next<ul><li>a<li>b<ol start=3><li>c<li>d</ol>"
        "</ul><table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>x<td>44</table>"
        "<pre>  k\n   v</pre><div hidden>no</div><div style='display: none'>no</div>end<br>line"
        "<script>bad</script> tail &amp; <span>sp</span>an") == (
        "Hi there, you\n\nNext\n\n- a\n- b\n  3. c\n  4. d\n\nName       Qty\napple pie  3\n"
        "x          44\n\n  k\n   v\n\nend\nline tail & span")
    assert html_to_text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    for damaged in (None, "", "<", "<p", "a<b", "<!-- x", "<p class='x>text", "</p></div>x",
                    "<script>x", "<ul><li>" * 3, "<table><tr><td><table><td>x", "&#0;&bogus;"):
        html_to_text(damaged)
    deep = html_to_text("<div>" * 5000 + "in" + "</div>" * 5000 + "out")
    assert deep == "in\nout"
    assert html_to_text("<td>" * 300 + "x") == "x"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, "a"), (None, "<p>x", "b"), (2, "", "c"), (2, "", "c")],
                                  "page_id bigint, html string, text string")
    got = queries.html_text.extract_text(pages).collect()
    assert sorted((r.page_id or -1, r.text, r.n_chars) for r in got) == [
        (-1, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0)]


def test_chunked_framing():
    body = bytes(range(256)) * 100
    assert warc.decode_chunked(warc.chunk_body(body, 1000)) == body
    assert warc.decode_chunked(warc.chunk_body(b"")) == b""
    assert warc.decode_chunked(b"5\r\nab") is None and warc.decode_chunked(b"zz\r\n") is None


def test_warc_round_trip(spark):
    big = "é\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "u\n1", "x" * 2000, 0), (2, None, "x" * 2000, 0), (7, "u", "x" * 2000, 0),
            (3, "u", "y", 0), (4, "u", "y", 0), (5, "u", None, 0), (6, "u", big, 0),
            (None, "u", big, 0), (8, "u", "x" * 2000, 0), (8, "u", "x" * 2000, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    path = shared_folder(spark)
    warc.write_warc(pages, path, segment_bytes=10_000)
    types = {r.warc_type for r in warc.read_records(spark, path).collect()}
    assert types == {"response", "revisit", "continuation"}
    got = warc.read_warc(spark, path, keep_payload=True).collect()
    assert len(got) == len(rows) and all(r.valid for r in got)
    for r in got:
        html = next(h for p, _, h, _ in rows if p == r.page_id) or ""
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        if r.record_type == "response":
            assert bytes(r.payload) == html.encode()
    assert sorted((r.page_id or -1, r.refers_to) for r in got if r.record_type == "revisit") == [
        (-1, 6), (1, 8), (2, 8), (7, 8)]
    empty = shared_folder(spark)
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_damaged_segments_are_reported(spark):
    row = ("response", 1, "u", 4, hashlib.sha1(b"abcd").hexdigest(), None)
    message = b"HTTP/1.1 200 OK\r\n\r\nabcd"

    def records(*segments):
        out = [("o" if i == 1 else f"o/{i}", None if i == 1 else "o", i, total,
                *(row if i == 1 else ("continuation", *[None] * 5)), block)
               for i, total, block in segments]
        got = warc.reassemble(spark.createDataFrame(out, warc.RECORD)).collect()
        return [(r.complete, b"".join(bytes(b) for b in r.blocks)) for r in got]

    a, b = message[:10], message[10:]
    assert records((2, len(message), b), (1, None, a)) == [(True, message)]
    assert not records((1, None, a), (2, len(message) + 1, b))[0][0]
    assert not records((1, None, a), (3, len(message), b))[0][0]
    assert not records((1, None, a), (2, None, b))[0][0]


def test_damaged_archives_become_rows(spark, tmp_path):
    import gzip

    assert warc.decode_chunked(b"-6\r\n" + b"x" * 20) is None
    assert warc.decode_chunked(b"+3\r\nabc\r\n0\r\n\r\n") is None
    assert warc.decode_chunked(b"3;a=b\r\nabc\r\n0\r\n\r\n") == b"abc"

    def record(page, length=None, **more):
        block = b"HTTP/1.1 200 OK\r\n\r\nbody"
        head = {"WARC-Type": "response", "page-id": page, "WARC-Payload-Digest":
                "sha1:" + hashlib.sha1(b"body").hexdigest(),
                "Content-Length": len(block) if length is None else length, **more}
        lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v != "")
        return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"

    archives = {
        "good": record(1) + record(2),
        "cut": record(3) + record(4, length=10_000),
        "headless": record(5, length="") + record(6) + b"junk\r\n\r\n" + record(7),
        "odd": record(8, length=-4) + record("x") + record(9),
    }
    for name, content in archives.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(gzip.compress(content))
    (tmp_path / "broken.warc.gz").write_bytes(b"no archive at all")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got if r.valid) == [1, 2, 3, 6, 7, 9]
    bad = [r for r in got if not r.valid]
    assert {r.record_type for r in bad} == {"damaged"} and len(bad) == 6
    assert all(r.payload_bytes is None for r in bad)
