"""Token counts by overlap resynchronisation.

Texts of ordinary length are encoded whole. A huge text is cut into chunks that overlap; the chunks
are rows, so one document spreads over many tasks, and each is encoded with its offsets. Two
neighbours are spliced at a position that is a piece boundary in both encodings and lies at least
``MARGIN`` characters before the end of the left one: up to there the left encoding has seen all
that can influence it, and from a piece boundary on matching does not look back, so both continue
as the encoding of the whole text does. A text with a pair of neighbours without such a position
goes round again with chunks and overlaps ``WIDEN`` times as long; at the latest, one chunk holds
the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.encoding import encoder, load_tokenizer, slices, tidy
from askgrid.plans.shared import written

CHUNK = 32_768
OVERLAP = 1_024
HUGE = 65_536
WIDEN = 8
#: Longer than any look-ahead of the patterns and any special string.
MARGIN = 32
LIMIT = 512

_MARKS = "array<struct<at:bigint,tokens:bigint>>"
_LOADED: dict = {}


def _count_whole(file: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file, counts_only=True)
        for batch in batches:
            texts = batch.column(1)
            for start, size in slices(texts):
                part = texts.slice(start, size)
                sizes = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, size), sizes, pa.array(enc.counts(part))],
                    names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk: int, overlap: int):
    """One row per chunk of each text; the last may be short but is never inside the overlap."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                last = max(0, -(-(len(text) - overlap) // chunk) - 1)
                for i in range(last + 1):
                    lo = i * chunk
                    piece = text[lo:] if i == last else text[lo:lo + chunk + overlap]
                    yield pa.RecordBatch.from_pydict({
                        "key": [key], "i": pa.array([i], pa.int64()),
                        "start": pa.array([lo], pa.int64()), "last": [i == last],
                        "piece": [piece]})

    return run


def piece_boundaries(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece starts, and the number of tokens before each."""
    begins = np.array([o[0] for o in encoding.offsets], np.int64)
    words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
    if not begins.size:
        return begins, begins
    fresh = np.ones(begins.size, bool)
    fresh[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    fresh[1:] &= begins[1:] > begins[:-1]
    tokens = np.flatnonzero(fresh)
    return begins[tokens], tokens


def _encode_chunks(file: str, chunk: int, overlap: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file not in _LOADED:
            _LOADED[file] = load_tokenizer(file)
        tokenizer = _LOADED[file]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                encoding = tokenizer.encode(row["piece"], add_special_tokens=False)
                at, tokens = piece_boundaries(encoding)
                head = at <= overlap
                tail = (at >= chunk) & (at <= len(row["piece"]) - MARGIN)
                pairs = [
                    [{"at": int(a) + row["start"], "tokens": int(t)}
                     for a, t in zip(at[mask], tokens[mask])]
                    for mask in (head, tail)
                ]
                out.append({"key": row["key"], "i": row["i"], "last": row["last"],
                            "total": len(encoding), "head": pairs[0], "tail": pairs[1]})
            if out:
                marks = pa.list_(pa.struct([("at", pa.int64()), ("tokens", pa.int64())]))
                yield pa.RecordBatch.from_pylist(out, pa.schema([
                    ("key", pa.string()), ("i", pa.int64()), ("last", pa.bool_()),
                    ("total", pa.int64()), ("head", marks), ("tail", marks)]))

    return run


def splice(chunks: DataFrame) -> DataFrame:
    """``key, n_tokens`` from encoded chunks; ``n_tokens`` is null where a pair did not align."""
    order = Window.partitionBy("key").orderBy("i")
    common = F.array_max(F.array_intersect(F.col("tail.at"), F.col("next_head.at")))

    def tokens_at(marks: str):
        return F.get(F.filter(marks, lambda m: m["at"] == F.col("common")), 0)["tokens"]

    return (
        chunks.withColumn("next_head", F.lead("head").over(order))
        .withColumn("common", F.when(~F.col("last"), common))
        .withColumn("part", F.when(F.col("last"), F.col("total")).otherwise(
            tokens_at("tail") - tokens_at("next_head")))
        .groupBy("key")
        .agg(F.sum("part").alias("n_tokens"),
             F.count(F.when(F.col("part").isNull(), 1)).alias("unaligned"))
        .select("key", F.when(F.col("unaligned") == 0, F.col("n_tokens")).alias("n_tokens"))
    )


def _count_huge(texts: DataFrame, file: str, chunk: int, overlap: int) -> DataFrame:
    """``key, n_tokens`` of ``key, text`` (keys unique), in as many rounds as alignment needs."""
    done: DataFrame | None = None
    rest = texts
    while True:
        cut = rest.mapInArrow(_cut(chunk, overlap),
                              "key string, i bigint, start bigint, last boolean, piece string")
        encoded = cut.repartition("key", "i").mapInArrow(
            _encode_chunks(file, chunk, overlap),
            f"key string, i bigint, last boolean, total bigint, head {_MARKS}, tail {_MARKS}")
        counted = written(splice(encoded))
        good = counted.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = counted.where("n_tokens is null").select("key")
        if failed.isEmpty():
            return done
        rest = texts.join(failed, "key", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def token_counts(
    docs: DataFrame,
    file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    huge: int = HUGE,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, by the tokenizer in ``file``.

    Counts are those of one call of the library over the whole text, without added special tokens;
    special strings inside a text count as the library's default has it. Null text counts as
    empty: 0 bytes, 0 tokens. A null id is kept as null. Repeated rows give repeated rows. Other
    columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_huge = F.length("text") > huge
    small = rows.where(~is_huge).mapInArrow(
        _count_whole(file), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    keyed = rows.where(is_huge).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.sha2("text", 256).alias("key"), "text")
    # Copies of a huge text are encoded once.
    counts = _count_huge(keyed.select("key", "text").dropDuplicates(["key"]), file, chunk, overlap)
    large = keyed.select("doc_id", "n_bytes", "key").join(counts, "key").select(
        "doc_id", "n_bytes", "n_tokens")
    return small.unionByName(large).withColumn("over_limit", F.col("n_tokens") > limit)
