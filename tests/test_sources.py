import json

from askgrid.operators.admission import admit_documents, extension
from askgrid.plans.shared import spread
from askgrid.sources import corpus, snapshots
from conftest import rows
from pyspark.sql import functions as F
import pytest


def test_scan_corpus_and_front_matter(spark, tmp_path):
    root = tmp_path / "kb v1"
    (root / "01_a" / "deep").mkdir(parents=True)
    (root / "01_a" / "deep" / "x.md").write_text("---\ndoc_id: A_1\n---\n# T\n")
    (root / "01_a" / "y.md").write_text("no key")
    (root / "01_a" / "z.md").write_text("doc_id: A_1\ndoc_id: B_2\n")
    (root / "01_a" / "skip.txt").write_text("doc_id: C_3")
    files = corpus.scan_corpus(spark, str(root)).withColumn("text", F.col("content").cast("string"))
    # The scheme of a local path escapes the blank in the folder name.
    assert rows(files, "category", "relative_path", "filename")[0] == (
        "01_a", "01_a/deep/x.md", "x.md")
    good, bad = corpus.extract_front_matter_id(files)
    assert rows(good, "filename", "doc_key") == [("x.md", "A_1")]
    assert rows(bad, "filename", "reject_code") == [
        ("y.md", "doc_id_missing"), ("z.md", "doc_id_repeated")]


def test_eval_set_rejects_blank_and_malformed_lines(spark, tmp_path):
    sample = {"query_id": "q1", "query": "x", "requires_rag": True, "expected_doc_ids": ["A"]}
    path = tmp_path / "set.jsonl"
    path.write_text(json.dumps(sample) + "\n\n{broken\n" + json.dumps({"query": "no id"}) + "\n")
    samples, rejects = corpus.read_eval_set(spark, str(path))
    row = samples.first()
    assert (row["query_id"], row["requires_tool"], row["expected_doc_ids_nice"]) == ("q1", False, [])
    assert rows(rejects, "reject_code") == [
        ("blank_line",), ("malformed_line",), ("malformed_line",)]


@pytest.mark.parametrize("name,want", [
    ("a.TXT", ".txt"), ("a.tar.gz", ".gz"), (".txt", ""), ("a.", ""), ("d.x/f", ""),
    ("d\\f.md", ".md"), ("..txt", ".txt"),
])
def test_extension(spark, name, want):
    assert spark.range(1).select(extension(F.lit(name))).first()[0] == want


def test_admission_codes_in_order(spark):
    cases = [
        ("a.txt", None, b"", "empty_file"),
        ("a.txt", None, b"x" * 101, "file_too_large"),
        ("a.exe", "text/plain", b"x", "unsupported_type"),
        ("a", None, b"x", "unsupported_type"),
        ("a.txt", "image/png", b"x", "type_mismatch"),
        ("a.md", "text/plain", b"x", "type_mismatch"),
        ("a.pdf", "application/pdf", b"PDF", "invalid_file_signature"),
        ("a.pdf", None, b"%PDF-1.7\x00", None),
        ("a.docx", None, b"PK\x03\x04..PK\x05\x06", None),
        ("a.docx", None, b"PK", "invalid_file_signature"),
        ("a.txt", None, b"x\x00y", "binary_content"),
        ("a.txt", None, b"\xff", "invalid_encoding"),
        ("a.txt", None, b"y" * 60, "resource_limit_exceeded"),
        ("a.txt", None, "x\u0085".encode(), "binary_content"),
        ("a.txt", "application/octet-stream", b"\xef\xbb\xbfa\r\nb\rc\t", None),
        ("a", "text/markdown; charset=utf-8", b"# x", None),
    ]
    df = spark.createDataFrame([(i, n, m, bytearray(c)) for i, (n, m, c, _) in enumerate(cases)],
                               "doc_id int, filename string, media_type string, content binary")
    good, bad = admit_documents(df, max_bytes=100, max_chars=50)
    found = {r["doc_id"]: r["reject_code"] for r in bad.collect()}
    assert found == {i: c[3] for i, c in enumerate(cases) if c[3]}
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert texts[14] == "a\nb\nc\t" and texts[7] is None and texts[15] == "# x"
    with pytest.raises(Exception, match="document rejected"):
        admit_documents(df, strict=True, max_bytes=100, max_chars=50)[0].collect()


def test_snapshots_switch_only_when_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.read_snapshot(spark, path, "id long").count() == 0
    assert snapshots.write_snapshot(spark.range(3), path) == 1
    assert snapshots.write_snapshot(spark.range(5), path) == 2
    assert snapshots.write_snapshot(spark.range(9), path, snapshot=2) == 2
    assert snapshots.read_snapshot(spark, path).count() == 5
    (tmp_path / "t" / "snapshot=2" / "_SUCCESS").unlink()
    assert snapshots.read_snapshot(spark, path).count() == 3
    assert snapshots.write_snapshot(spark.range(7), path) == 3
    assert snapshots.read_snapshot(spark, path, snapshot=1).count() == 3


def test_reports_are_json_lines(spark, tmp_path):
    snapshots.write_report(spark.range(2), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(0, 10, 1, 50)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 10, 1, 1), "id").rdd.getNumPartitions() == 4
