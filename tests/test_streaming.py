import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from askgrid.operators.runs import EVENT_SCHEMA, fold_runs
from askgrid.streaming.ingest import (
    file_stream, ingest_batch, ingest_stream, read_active_chunks, read_heads, read_versions,
)
from askgrid.streaming.runs import fold_runs_stream
from conftest import rows
from test_memory_runs import DONE, EVENTS, EXPECTED, event

T0 = datetime(2024, 1, 1)


def run_stream(spark, tmp_path, batches, **options):
    """Write each batch as a file, run the fold to the end after each, read all output."""
    schema = EVENT_SCHEMA + ", ts timestamp"
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(
            str(source / f"b{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(
            str(source))
        query = (
            fold_runs_stream(stream, **options).writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert query.exception() is None
    return spark.read.parquet(out)


def at(e, seconds=0):
    return {**e, "ts": T0 + timedelta(seconds=seconds)}


def test_stream_equals_batch_rules_out_of_order(spark, tmp_path):
    closing = [at(event(99, 0, "begin"), 1000)]
    late = [e for e in EVENTS if e["run_id"] == 1 and e["seq"] == 1]
    first = [e for e in EVENTS if e not in late]
    out = run_stream(spark, tmp_path, [[at(e) for e in first], [at(e) for e in late], closing],
                     delay="30 seconds", timeout_seconds=60)
    found = {r["run_id"]: (r["status"], r["answer"], r["error_code"])
             for r in out.where("status <> 'late_events'").collect()}
    want = {**EXPECTED, 5: ("failed", None, "global_timeout")}
    # A stream closes run 1 at its first terminal event once the missing event came.
    assert found == want


def test_late_events_are_counted_not_applied(spark, tmp_path):
    first = [at(event(1, 0, "content", "a")), at(event(1, 1, "done", **DONE))]
    second = [at(event(1, 2, "content", "b"), 1), at(event(1, 3, "content", "c"), 1)]
    out = run_stream(spark, tmp_path, [first, second, [at(event(9, 0, "begin"), 500)]],
                     delay="5 seconds", timeout_seconds=60)
    assert rows(out.where("run_id = 1"), "status", "answer", "late_events") == [
        ("completed", "a", 0), ("late_events", None, 2)]


def random_run(rng, run):
    """Events of a run: valid and broken orders, sometimes events after its end."""
    kinds = [rng.choice(["begin", "content", "content", "content", "sources", "guidance"])
             for _ in range(rng.randrange(1, 9))]
    kinds += [rng.choice(["done", "done", "done", "error", "cancel"])]
    kinds += ["content"] * rng.choice([0, 0, 2])
    trace = [("retrieve", 2.5, 3, None, None), ("answer", 1.0, None, "slow", "kept")]
    return [event(run, i, k, text=f"{run}-{i};", **(
        {**DONE, "trace": trace} if k == "done" else {}), **(
        {"source_ids": ["s", str(i)]} if k == "sources" else {})) for i, k in enumerate(kinds)]


def test_stream_equals_the_batch_fold_over_shuffled_batches_and_restarts(spark, tmp_path):
    rng = random.Random(17)
    events = [at(e, rng.randrange(20)) for run in range(40) for e in random_run(rng, run)]
    rng.shuffle(events)
    cuts = sorted(rng.sample(range(len(events)), 5))
    batches = [events[a:b] for a, b in zip([0, *cuts], [*cuts, len(events)])]
    # Batches overlap in time by far more than a run lasts; a repeat is given twice.
    batches[-1] = [*batches[-1], batches[0][0], at(event(99, 0, "begin"), 21)]
    out = run_stream(spark, tmp_path, batches, delay="10 minutes", timeout_seconds=3600)
    fields = ("run_id", "conversation_id", "status", "answer", "source_chunk_ids", "trace",
              "model_id", "output_tokens", "error_code")
    schema = EVENT_SCHEMA + ", ts timestamp"
    want = fold_runs(spark.createDataFrame(events, schema).drop("ts"))
    got = out.where("status <> 'late_events'")
    assert rows(got, *fields) == rows(want, *fields)
    assert {r.status for r in got.collect()} >= {"completed", "failed", "cancelled"}


def test_a_long_run_is_one_answer(spark, tmp_path):
    parts = [at(event(1, i, "content", f"{i};"), i % 30) for i in range(3000)]
    done = at(event(1, 3000, "done", **DONE), 40)
    out = run_stream(spark, tmp_path, [parts[1500:], parts[:1500], [done]], timeout_seconds=600)
    assert out.first().answer == "".join(f"{i};" for i in range(3000))


def test_ingest_versions_and_replays(spark, tmp_path):
    root = str(tmp_path / "kb")
    schema = ("knowledge_base_id string, source_key string, filename string, media_type string, "
              "content binary, attempt_seq long")

    def batch(*files):
        return spark.createDataFrame(
            [("kb", k, f"{k}.{x}", None, bytearray(c), s) for k, x, c, s in files], schema)

    one = batch(("a", "txt", b"one two", 1), ("b", "md", b"# T\n\ntext", 2), ("c", "exe", b"x", 3),
                ("d", "txt", b" ", 4))
    options = dict(dimension=8)
    ingest_batch(one, 0, root, **options)
    assert rows(read_versions(spark, root), "source_key", "version_number", "status") == [
        ("a", 1, "active"), ("b", 1, "active")]
    rejects = spark.read.parquet(f"{root}/rejects")
    assert rows(rejects, "source_key", "reject_code") == [
        ("c", "unsupported_type"), ("d", "empty_content")]
    two = batch(("a", "txt", b"one two", 5), ("b", "md", b"# T\n\nnew", 6), ("b", "md", b"# U", 7))
    ingest_batch(two, 1, root, **options)
    ingest_batch(two, 1, root, **options)
    assert rows(read_versions(spark, root), "source_key", "version_number", "status") == [
        ("a", 1, "active"), ("b", 1, "superseded"), ("b", 2, "superseded"), ("b", 3, "active")]
    assert rows(read_active_chunks(spark, root), "content") == [("U",), ("one two",)]
    assert rows(read_heads(spark, root), "source_key", "last_version") == [("a", 1), ("b", 3)]


def test_failed_embedding_keeps_the_old_version(spark, tmp_path):
    import numpy as np

    root = str(tmp_path / "kb")
    schema = ("knowledge_base_id string, source_key string, filename string, media_type string, "
              "content binary, attempt_seq long")

    def load():
        return lambda texts: np.array([[0.0, 0.0] if "bad" in t else [1.0, 0.0] for t in texts])

    for epoch, text in enumerate([b"good", b"bad text", b"fine"]):
        df = spark.createDataFrame([("kb", "a", "a.txt", None, bytearray(text), epoch)], schema)
        ingest_batch(df, epoch, root, dimension=2, load=load)
    assert rows(read_versions(spark, root), "version_number", "status", "error_code") == [
        (1, "superseded", None), (2, "failed", "embedding_protocol"), (3, "active", None)]


def test_file_stream_ingest(spark, tmp_path):
    folder = tmp_path / "files"
    (folder / "kb1").mkdir(parents=True)
    (folder / "kb1" / "a.txt").write_text("hello world")
    root, state = str(tmp_path / "kb"), str(tmp_path / "state")

    def run():
        query = ingest_stream(file_stream(spark, str(folder)), root, state, available_now=True,
                              dimension=8)
        query.awaitTermination()
        assert query.exception() is None

    run()
    (folder / "kb1" / "b.txt").write_text("second file")
    run()
    assert rows(read_versions(spark, root), "knowledge_base_id", "source_key", "status") == [
        ("kb1", "kb1/a.txt", "active"), ("kb1", "kb1/b.txt", "active")]
    assert read_active_chunks(spark, root).where(F.col("violation").isNull()).count() == 2


def test_a_lost_checkpoint_drops_nothing(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "tables")
    (inbox / "kb").mkdir(parents=True)

    def run(checkpoint):
        ingest_stream(file_stream(spark, str(inbox)), root, str(tmp_path / checkpoint),
                      available_now=True, dimension=2).awaitTermination()
        return sorted((r.source_key, r.version_number, r.status)
                      for r in read_versions(spark, root).collect())

    (inbox / "kb" / "a.txt").write_text("first")
    (inbox / "kb" / "b.txt").write_text("second")
    assert run("one") == [("kb/a.txt", 1, "active"), ("kb/b.txt", 1, "active")]
    assert run("one") == run("one")
    # Another checkpoint counts its batches from 0 again: known files are skipped as unchanged,
    # new ones are ingested.
    (inbox / "kb" / "c.txt").write_text("third")
    assert run("two") == [("kb/a.txt", 1, "active"), ("kb/b.txt", 1, "active"),
                          ("kb/c.txt", 1, "active")]
    (inbox / "kb" / "d.txt").write_text("fourth")
    assert len(run("one")) == 4 and len(run("two")) == 4


def test_attempts_inside_a_batch_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "tables")
    schema = ("knowledge_base_id string, source_key string, filename string, media_type string, "
              "content binary, attempt_seq bigint")
    batch = spark.createDataFrame(
        [("kb", "a", "a.txt", None, bytearray(t), i)
         for i, t in enumerate([b"x", b"x", b"y", b"y", b"x"])], schema)
    ingest_batch(batch, 0, root, dimension=2)
    got = sorted((r.version_number, r.attempt_seq, r.status)
                 for r in read_versions(spark, root).collect())
    assert got == [(1, 0, "superseded"), (2, 2, "superseded"), (3, 4, "active")]


def test_uploads_of_the_same_text_are_versions(spark, tmp_path):
    root = str(tmp_path / "tables")
    schema = ("knowledge_base_id string, source_key string, filename string, media_type string, "
              "content binary, attempt_seq bigint")
    texts = [b"x", b"x", b"y", b"y"]
    for epoch in range(2):
        batch = spark.createDataFrame(
            [("kb", "a", "a.txt", None, bytearray(t), 4 * epoch + i)
             for i, t in enumerate(texts[:: 1 - 2 * epoch])], schema)
        ingest_batch(batch, epoch, root, dimension=2, skip_unchanged=False)
    assert rows(read_versions(spark, root), "version_number", "attempt_seq", "status") == [
        (i + 1, i, "active" if i == 7 else "superseded") for i in range(8)]
    assert read_active_chunks(spark, root).count() == 1


def test_documents_without_words_are_versions_in_the_ingest_query(spark, tmp_path):
    import duckdb
    from askgrid.workload import streams

    texts = [("a", "one two"), ("a", ""), ("b", None), ("b", "w " * 737), ("a", "x"), ("b", " \n"),
             ("c", ""), ("a", "\u3000")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(texts)],
                          "doc_id long, text string, lang string, source string").write.parquet(path)
    got = streams.R.queries["h1_ingest_stream"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    want = con.execute(streams.R.sql["h1_ingest_stream"])
    columns = [c[0] for c in want.description]
    assert rows(got, *columns) == sorted(want.fetchall(), key=repr)
    assert got.count() == len(texts)


def test_runs_of_one_bucket_share_its_state_and_its_timer(spark, tmp_path, monkeypatch):
    from askgrid.streaming import runs as stream_runs

    monkeypatch.setattr(stream_runs, "BUCKETS", 2)
    begun = {run: 10 * run for run in range(30)}
    first = [at(event(run, 1, "content", "b"), s) for run, s in begun.items()]
    second = [at(event(run, 0, "content", "a"), s) for run, s in begun.items() if run % 3]
    done = [at(event(run, 2, "done", **DONE), s + 1) for run, s in begun.items() if run % 3 == 1]
    # The watermark ends at 250 s: what began before 190 s and is open has run out of time.
    out = run_stream(spark, tmp_path, [first, second, done, [at(event(99, 0, "begin"), 850)]],
                     delay="10 minutes", timeout_seconds=60)
    want = {run: ("completed", "ab") if run % 3 == 1 else ("failed", None) for run in begun
            if run % 3 == 1 or 10 * run + 60 < 250}
    assert {r.run_id: (r.status, r.answer) for r in out.collect()} == want
    # All runs lie under two state keys; the old fold had a key for each.
    keys = spark.read.format("statestore").option("stateVarName", "heads").load(
        str(tmp_path / "state"))
    assert keys.count() <= 2
