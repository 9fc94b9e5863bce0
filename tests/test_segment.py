import random

from askgrid.operators import segment
from conftest import rows


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def paragraphs(text):
    """Plain re-statement of the paragraph rule."""
    out, start, held = [], 0, []
    lines = text.split("\n")
    for no, line in enumerate([*lines, ""], 1):
        if line.strip():
            start = start or no
            held.append(line.rstrip())
        elif held:
            out.append(("\n".join(held).strip(), start, no - 1))
            start, held = 0, []
    return out


def test_paragraphs_match_plain_loop(spark):
    rng = random.Random(2)
    texts = ["", "\n\n", "a", " a \n\tb\t\n　\nc", "x\n\n\n y\nz\n"]
    texts += ["\n".join(rng.choice(["", " ", "word ", "  two words", " "])
                        for _ in range(rng.randrange(30))) for _ in range(60)]
    got = rows(segment.segment_paragraphs(docs(spark, *texts)),
               "doc_id", "ordinal", "text", "start_line", "end_line")
    want = [(d, o, *p) for d, t in enumerate(texts) for o, p in enumerate(paragraphs(t))]
    assert got == sorted(want, key=repr)


def blocks(spark, text):
    return [
        (b["kind"], b["text"], b["start_line"], b["end_line"], tuple(b["section_path"]),
         b["heading_level"], b["code_language"])
        for b in segment.segment_markdown(docs(spark, text)).orderBy("ordinal").collect()
    ]


def test_markdown_structure(spark):
    text = ("# Guide #\n\nIntro **bold** and `code`\nsecond line\n\n## Steps\n- one\n- *two*\n"
            "  more\n1. three\n\n```python x\nprint(1)\n\n# not a heading\n```\n### Deep\n"
            "[link](http://x) text\n## Next\ntail")
    assert blocks(spark, text) == [
        ("heading", "Guide", 1, 1, ("Guide",), 1, None),
        ("paragraph", "Intro bold and code\nsecond line", 3, 4, ("Guide",), None, None),
        ("heading", "Steps", 6, 6, ("Guide", "Steps"), 2, None),
        ("list_item", "one", 7, 7, ("Guide", "Steps"), None, None),
        ("list_item", "two\nmore", 8, 9, ("Guide", "Steps"), None, None),
        ("list_item", "three", 10, 10, ("Guide", "Steps"), None, None),
        ("code_block", "print(1)\n\n# not a heading", 12, 16, ("Guide", "Steps"), None,
         "python"),
        ("heading", "Deep", 17, 17, ("Guide", "Steps", "Deep"), 3, None),
        ("paragraph", "link text", 18, 18, ("Guide", "Steps", "Deep"), None, None),
        ("heading", "Next", 19, 19, ("Guide", "Next"), 2, None),
        ("paragraph", "tail", 20, 20, ("Guide", "Next"), None, None),
    ]


def test_markdown_fences_underlines_and_rules(spark):
    assert blocks(spark, "~~~\n```\nx\n~~~~\nTitle\n===\n\n---\n\nSub\nline\n---\n```\nopen") == [
        ("code_block", "```\nx", 1, 4, (), None, None),
        ("heading", "Title", 5, 6, ("Title",), 1, None),
        ("heading", "Sub\nline", 10, 12, ("Title", "Sub\nline"), 2, None),
        ("code_block", "open", 13, 14, ("Title", "Sub\nline"), None, None),
    ]
    assert blocks(spark, "#\n\n```\n```\n\n") == []
    assert blocks(spark, "snake_case_name stays\n#tag too") == [
        ("paragraph", "snake_case_name stays\n#tag too", 1, 2, (), None, None)]


def csv_case(spark, text, **limits):
    good, bad = segment.segment_csv(docs(spark, text), **limits)
    return (rows(good, "ordinal", "text", "start_line", "end_line"),
            [r["reject_code"] for r in bad.collect()])


def test_csv_records(spark):
    text = 'name,policy\nA,"one, ""two""\nthree"\n\n , \nB, x \n'
    assert csv_case(spark, text) == (
        [(0, 'name: A\npolicy: one, "two"\nthree', 2, 3), (1, "name: B\npolicy: x", 6, 6)], [])
    head = "\n\nx,x,,x\n1,2,3,4"
    assert csv_case(spark, head) == (
        [(0, "x: 1\nx (2): 2\n列 3: 3\nx (3): 4", 4, 4)], [])


def test_csv_rejects(spark):
    assert csv_case(spark, "a,b\n1\n")[1] == ["malformed_document"]
    assert csv_case(spark, 'a,b\n"1"x,2\n')[1] == ["malformed_document"]
    assert csv_case(spark, 'a,b\n"1,2\n')[1] == ["malformed_document"]
    assert csv_case(spark, "a,b\n")[1] == ["empty_content"]
    assert csv_case(spark, "\n \n")[1] == ["empty_content"]
    assert csv_case(spark, "a,b\n1,2\n3,4", max_rows=1)[1] == ["resource_limit_exceeded"]
    assert csv_case(spark, "a,b\n1,2", max_columns=1)[1] == ["resource_limit_exceeded"]
    assert csv_case(spark, "a,b\n1,2", max_chars=3)[1] == ["resource_limit_exceeded"]


def test_csv_matches_the_standard_reader(spark):
    import csv
    import io

    rng = random.Random(4)
    cells = ["", "a", " b ", 'q"x', "c,d", "l1\nl2", '"', "é"]
    for _ in range(15):
        table = [[f"h{i}" for i in range(3)]] + [
            [rng.choice(cells) for _ in range(3)] for _ in range(rng.randrange(1, 8))]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(table)
        reader = csv.reader(io.StringIO(out.getvalue(), newline=""), strict=True)
        next(reader)
        want, before = [], reader.line_num
        for row in reader:
            start, before = before + 1, reader.line_num
            values = [v.strip() for v in row]
            if any(values):
                want.append((len(want), "\n".join(f"h{i}: {v}" for i, v in enumerate(values)),
                             start, before))
        assert csv_case(spark, out.getvalue())[0] == sorted(want, key=repr)


def test_with_blocks_by_format(spark):
    df = spark.createDataFrame(
        [(1, "plain_text", "a\n\nb"), (2, "markdown", "# a"), (3, "csv", "a\n1"),
         (4, "pdf", None), (5, "plain_text", " ")],
        "doc_id long, document_format string, text string")
    out = segment.with_blocks(df).selectExpr("doc_id", "coalesce(size(blocks), -1)", "parse_code")
    assert rows(out) == [(1, 2, None), (2, 1, None), (3, 1, None), (4, -1, "unsupported_type"),
                         (5, 0, "empty_content")]


def short(spark, text):
    return [b[:4] for b in blocks(spark, text)]


def test_markdown_containers_and_code(spark):
    assert short(spark, "> quoted\n> more\n\nplain\n> again") == [
        ("paragraph", "quoted\nmore", 1, 2), ("paragraph", "plain", 4, 4),
        ("paragraph", "again", 5, 5)]
    assert short(spark, "- one\n\n  second para\n\n  - nested\n    tail\n\nout") == [
        ("list_item", "one", 1, 1), ("list_item", "second para", 3, 3),
        ("list_item", "nested\ntail", 5, 6), ("paragraph", "out", 8, 8)]
    assert short(spark, "    code a\n\n    code b\nnot\n    lazy") == [
        ("code_block", "code a\n\ncode b", 1, 3), ("paragraph", "not\nlazy", 4, 5)]
    assert short(spark, "> ```py\n> x\n> ```\nafter") == [
        ("code_block", "x", 1, 3), ("paragraph", "after", 4, 4)]
    assert short(spark, "para\n2. not item\n\n2) item") == [
        ("paragraph", "para\n2. not item", 1, 2), ("list_item", "item", 4, 4)]
    assert short(spark, "a &amp;&lt; <https://a.b/c>") == [("paragraph", "a &< https://a.b/c", 1, 1)]


def test_long_blocks_and_many_blocks_keep_their_lines(spark):
    many = blocks(spark, "\n".join(f"# h{i}" for i in range(400)))
    assert [b[1] for b in many] == [f"h{i}" for i in range(400)]
    assert all(b[4] == (b[1],) for b in many)
    lines = [f"word {i}" for i in range(700)]
    assert short(spark, "\n".join(lines)) == [("paragraph", "\n".join(lines), 1, 700)]


def test_csv_first_offender_decides_and_repeated_names(spark):
    assert csv_case(spark, "a,b\n1,2\n3,4\n5", max_rows=1)[1] == ["resource_limit_exceeded"]
    assert csv_case(spark, "a,b\n1\n3,4\n5,6", max_rows=1)[1] == ["malformed_document"]
    wide = ",".join(["a"] * 3000)
    assert csv_case(spark, wide + "\n" + wide)[1] == ["resource_limit_exceeded"]
    good, _ = segment.segment_csv(docs(spark, "x,,x,x\n1,2,3,4"))
    assert good.first()["text"] == "x: 1\n列 2: 2\nx (2): 3\nx (3): 4"


def test_whole_texts_are_segmented_and_chunked(spark, tmp_path):
    import hashlib

    from askgrid.workload import ingest

    text = "One - (two)! a@b\n# Own *title*\nthree & four\n- item\nfive | six"
    spark.createDataFrame([(1, text, "s", "en"), (2, "a-b\nc\nd\ne", "s", "en")],
                          "doc_id long, text string, source string, lang string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = rows(ingest.a9_segment_markdown_whole(spark, str(tmp_path)).where("ordinal >= 8"),
               "doc_id", "ordinal", "kind", "start_line", "end_line", "section", "text_sha256")
    outer = "s > Text of en"
    assert got == [(*row, hashlib.sha256(body.encode()).hexdigest()) for *row, body in [
        (1, 10, "paragraph", 23, 23, "Own title", "three & four"),
        (1, 11, "list_item", 25, 26, "Own title", "item\nfive | six"),
        (1, 8, "paragraph", 21, 21, outer, "One - (two)! a@b"),
        (1, 9, "heading", 22, 22, "Own title", "Own title"),
        (2, 8, "paragraph", 21, 23, outer, "a-b\nc\nd"),
        (2, 9, "paragraph", 25, 25, outer, "e")]]
    chunks = ingest.R.queries["a12_a13_a14_chunk_documents"](spark, str(tmp_path))
    assert {r["doc_id"]: r["last"] for r in chunks.groupBy("doc_id").agg(
        {"block_end_ordinal": "max"}).toDF("doc_id", "last").collect()} == {1: 11, 2: 9}


def test_last_line_of_a_block_is_found_once(spark):
    from pyspark.sql import functions as F

    # Inside the filter over a block's lines it was found again for each line of indented code.
    assert str(segment._markdown_raw(F.col("groups"))).count("blank") == 1
    text = "\n".join(f"    c{i}" for i in range(300))
    assert short(spark, text + "\n\n# h") == [
        ("code_block", text.replace("    ", ""), 1, 300), ("heading", "h", 302, 302)]


def test_plain_lines_need_no_rule(spark, monkeypatch):
    rng = random.Random(11)
    parts = ["", " ", "\t", "text", "more　", "# H", "- item", "1. one", "  in", "     deep",
             "\tcode", "```", "~~~", "> q", "> ```", "> - qi", ">", "===", "---", "***", "é", "> # h"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    frame = docs(spark, *texts)
    got = rows(segment.segment_markdown(frame))
    monkeypatch.setattr(segment, "_see_line", segment._see_marked_line)
    assert got == rows(segment.segment_markdown(frame))
