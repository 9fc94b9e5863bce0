"""Blocks to chunks: structure-aware packing, overlapping token windows, chunk assembly.

Everything happens inside the document's row; chunks appear by exploding one array, so their
index is the array position and no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.codecs import Codec, resolve_codec
from askgrid.functions.lets import let
from askgrid.operators.segment import FOLD_BATCH
from askgrid.functions.text import strip

TARGET_TOKENS = 400
OVERLAP_TOKENS = 64
SECTION_CHARS = 500
_PACK = ("struct<done:array<array<int>>,starts:array<int>,open:boolean,tokens:int,lone:boolean,"
         "path:array<string>>")


def _check(target: int, overlap: int) -> None:
    if target < 1 or not 0 <= overlap < target:
        raise ValueError("target must be positive and overlap smaller than target")


def token_windows(tokens: Column, codec: Codec, target: int, overlap: int) -> Column:
    """``array<struct<content, token_count, overlap>>`` of windows over a token array.

    No window without tokens, one up to ``target`` tokens, else ``ceil((n - overlap) / (target - overlap))``.
    """
    _check(target, overlap)
    step = target - overlap
    n = F.size(tokens)
    count = F.when(n <= target, F.least(n, F.lit(1))).otherwise(
        F.ceil((n - overlap) / step).cast("int"))

    def window(i: Column) -> Column:
        part = F.slice(tokens, i * step + 1, F.lit(target))
        content = strip(F.array_join(part, codec.joiner))
        # Joined words split back into the same words; other codecs may lose edge blanks.
        size = F.least(F.lit(target), n - i * step) if codec.joiner == " " else F.size(
            codec.encode(content))
        return F.struct(
            content.alias("content"),
            size.cast("int").alias("token_count"),
            F.when(i == 0, 0).otherwise(overlap).cast("int").alias("overlap"),
        )

    # Without tokens the counter array is cut to nothing.
    return F.transform(F.slice(F.sequence(F.lit(0), count), F.lit(1), count), window)


def window_tokens(df: DataFrame, key: str = "doc_id", text: str = "text",
                  target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS,
                  codec: str | Codec = "words") -> DataFrame:
    """Windows of whole texts as rows ``(key, window_index, content, token_count, overlap)``."""
    kind = resolve_codec(codec)
    tokens = df.select(key, kind.encode(F.col(text)).alias("_t"))
    return (
        tokens.select(key, F.posexplode(token_windows(F.col("_t"), kind, target, overlap)).alias(
            "window_index", "w"))
        .select(key, "window_index", "w.*")
    )


def pack_starts(blocks: Column, counts: Column, target: int, gap: int) -> Column:
    """0-based positions at which a new group of blocks starts.

    A heading or another section path starts a group. A block joins the open group while the
    joined text stays within ``target``; a lone heading keeps an oversized block with it.
    """
    items = F.transform(blocks, lambda b, i: F.struct(
        i.alias("i"), (b["kind"] == "heading").alias("heading"), b["section_path"].alias("path"),
        F.get(counts, i).alias("n")))

    def step(acc: Column, x: Column) -> Column:
        heading = x["heading"]
        room = acc["tokens"] + gap + x["n"] <= target
        fresh = ~acc["open"] | heading | (x["path"] != acc["path"])
        new = fresh | (~room & ~acc["lone"])
        fits = x["n"] <= target
        full = F.size(acc["starts"]) >= FOLD_BATCH
        return F.struct(
            # Starts are kept in batches, so that adding one never copies all before it.
            F.when(new & full, F.concat(acc["done"], F.array(acc["starts"]))).otherwise(
                acc["done"]).alias("done"),
            F.when(new, F.concat(F.when(full, F.array().cast("array<int>")).otherwise(
                acc["starts"]), F.array(x["i"].cast("int")))).otherwise(
                acc["starts"]).alias("starts"),
            F.when(new, fits).otherwise(room).alias("open"),
            F.when(new, x["n"]).otherwise(acc["tokens"] + gap + x["n"]).alias("tokens"),
            (new & heading & fits).alias("lone"),
            x["path"].alias("path"),
        )

    start = F.struct(
        F.array().alias("done"), F.array().alias("starts"), F.lit(False).alias("open"),
        F.lit(0).alias("tokens"),
        F.lit(False).alias("lone"), F.array().alias("path"),
    ).cast(_PACK)
    return F.aggregate(items, start, step, lambda acc: F.flatten(
        F.concat(acc["done"], F.array(acc["starts"]))))


def groups_of(blocks: Column, starts: Column) -> Column:
    """``array<array<BLOCK>>`` from group start positions."""
    return F.transform(
        starts,
        lambda s, i: F.slice(
            blocks, s + 1, F.coalesce(F.get(starts, i + 1), F.size(blocks)) - s
        ),
    )


def group_text(group: Column) -> Column:
    return F.array_join(F.transform(group, lambda b: b["text"]), "\n\n")


def _group_chunks(group: Column, counts: Column, codec: Codec, target: int, overlap: int
                  ) -> Column:
    """Chunks of one group: itself if it fits, else windows over its tokens."""
    first, last = F.element_at(group, 1), F.element_at(group, -1)

    def chunk(content: Column, token_count: Column, overlap_tokens: Column) -> Column:
        return F.struct(
            content.alias("content"),
            token_count.cast("int").alias("token_count"),
            overlap_tokens.cast("int").alias("overlap_tokens"),
            first["ordinal"].alias("block_start_ordinal"),
            last["ordinal"].alias("block_end_ordinal"),
            F.array_min(F.transform(group, lambda b: b["start_line"])).alias("start_line"),
            F.array_max(F.transform(group, lambda b: b["end_line"])).alias("end_line"),
            first["section_path"].alias("section_path"),
            first["page_number"].alias("page_number"),
        )

    def windows(tokens: Column) -> Column:
        return F.transform(token_windows(tokens, codec, target, overlap),
                           lambda w: chunk(w["content"], w["token_count"], w["overlap"]))

    def whole(text: Column, n: Column) -> Column:
        return F.array(chunk(text, n, F.lit(0)))

    if codec.gap == 0:
        # The counts of the blocks add up, so that only a group beyond the budget is encoded again.
        return let(F.aggregate(counts, F.lit(0), lambda acc, n: acc + n), lambda n: F.when(
            n <= target, whole(group_text(group), n)).otherwise(
            let(codec.encode(group_text(group)), windows)))
    return let(group_text(group), lambda text: let(codec.encode(text), lambda tokens: F.when(
        F.size(tokens) <= target, whole(text, F.size(tokens))).otherwise(windows(tokens))))


def _packed(df: DataFrame, codec: Codec, target: int) -> DataFrame:
    """Add ``_starts``, and ``_counts`` where they add up, to documents with a ``blocks`` array."""
    if codec.gap is not None:
        counts = F.transform("blocks", lambda b: F.size(codec.encode(b["text"])).cast("int"))
        return df.withColumn("_counts", counts).withColumn(
            "_starts", pack_starts(F.col("blocks"), F.col("_counts"), target, codec.gap))
    encode = codec.encode_texts
    if encode is None:
        raise ValueError("a codec without additive counts needs encode_texts")

    @F.pandas_udf("array<int>")
    def starts_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_greedy_starts(blocks, encode, target) for blocks in batch])

    return df.withColumn("_starts", starts_udf(F.to_json("blocks")))


def _greedy_starts(blocks_json: str, encode, target: int) -> list[int]:
    """Group starts when joined token counts must be asked from the tokenizer itself."""
    import json

    starts: list[int] = []
    joined, path, lone = None, None, False
    for i, block in enumerate(json.loads(blocks_json)):
        text, here = block["text"], block.get("section_path", [])
        heading = block["kind"] == "heading"
        if joined is not None and not heading and here == path:
            together = f"{joined}\n\n{text}"
            if len(encode([together])[0]) <= target:
                joined, lone = together, False
                continue
            if lone:
                joined, lone = None, False
                continue
        starts.append(i)
        fits = len(encode([text])[0]) <= target
        joined, path, lone = (text if fits else None), here, heading and fits
    return starts


def pack_blocks(df: DataFrame, key: str = "doc_id", target: int = TARGET_TOKENS,
                codec: str | Codec = "words") -> DataFrame:
    """Groups of blocks as rows ``(key, group_no, text, first and last block, section_path)``."""
    packed = _packed(df, resolve_codec(codec), target)
    groups = groups_of(F.col("blocks"), F.col("_starts"))
    return packed.select(key, F.posexplode(groups).alias("group_no", "g")).select(
        key,
        "group_no",
        group_text(F.col("g")).alias("text"),
        F.element_at("g", 1)["ordinal"].alias("block_start_ordinal"),
        F.element_at("g", -1)["ordinal"].alias("block_end_ordinal"),
        F.element_at("g", 1)["section_path"].alias("section_path"),
    )


def chunk_documents(df: DataFrame, key: str = "doc_id", target: int = TARGET_TOKENS,
                    overlap: int = OVERLAP_TOKENS, codec: str | Codec = "words") -> DataFrame:
    """Chunk rows from documents with a ``blocks`` array (see ``segment.with_blocks``)."""
    _check(target, overlap)
    kind = resolve_codec(codec)
    packed = _packed(df, kind, target)
    if kind.gap is None:
        return _chunk_user_codec(packed, key, kind, target, overlap)
    groups = F.arrays_zip(groups_of(F.col("blocks"), F.col("_starts")).alias("g"),
                          groups_of(F.col("_counts"), F.col("_starts")).alias("n"))
    chunks = F.flatten(
        F.transform(groups, lambda x: _group_chunks(x["g"], x["n"], kind, target, overlap))
    )
    return assemble_chunks(
        packed.select(key, F.posexplode(chunks).alias("chunk_index", "c")).select(
            key, "chunk_index", "c.*")
    )


def _chunk_user_codec(packed: DataFrame, key: str, codec: Codec, target: int, overlap: int
                      ) -> DataFrame:
    """A Python tokenizer cannot run inside a lambda: encode group rows, then number chunks."""
    groups = packed.select(
        key, F.posexplode(groups_of(F.col("blocks"), F.col("_starts"))).alias("group_no", "g")
    ).withColumn("_text", group_text(F.col("g")))
    tokens = groups.withColumn("_tokens", codec.encode(F.col("_text")))
    n = F.size("_tokens")
    step = target - overlap
    count = F.when(n <= target, 1).otherwise(F.ceil((n - overlap) / step).cast("int"))
    rows = tokens.withColumn("_i", F.explode(F.sequence(F.lit(0), count - 1)))
    part = F.slice("_tokens", F.col("_i") * step + 1, F.lit(target))
    first, last = F.element_at("g", 1), F.element_at("g", -1)
    cut = rows.select(
        key,
        "group_no",
        "_i",
        F.when(n <= target, F.col("_text")).otherwise(
            strip(F.array_join(part, codec.joiner))).alias("content"),
        F.size(part).alias("token_count"),
        F.when(F.col("_i") == 0, 0).otherwise(overlap).alias("overlap_tokens"),
        first["ordinal"].alias("block_start_ordinal"),
        last["ordinal"].alias("block_end_ordinal"),
        F.array_min(F.transform("g", lambda b: b["start_line"])).alias("start_line"),
        F.array_max(F.transform("g", lambda b: b["end_line"])).alias("end_line"),
        first["section_path"].alias("section_path"),
        first["page_number"].alias("page_number"),
    )
    from pyspark.sql import Window

    # A document's chunks are bounded by the admission limit, so one window group is small.
    order = Window.partitionBy(key).orderBy("group_no", "_i")
    return assemble_chunks(
        cut.withColumn("chunk_index", F.row_number().over(order) - 1).drop("group_no", "_i")
    )


def section_label(path: Column) -> Column:
    """Section path as one text of limited length; null without a section."""
    return F.when(F.size(path) > 0, F.substring(F.array_join(path, " > "), 1, SECTION_CHARS))


def assemble_chunks(df: DataFrame) -> DataFrame:
    """Add ``content_sha256`` and ``section`` to chunk rows."""
    return df.withColumns({
        "content_sha256": F.sha2("content", 256),
        "section": section_label(F.col("section_path")),
    })
