"""Approximate top-k over inverted lists of product-quantised codes, with filters of any strictness.

* Coarse centroids are trained on a bounded sample; each chunk joins the list of its nearest one.
* Second-level codebooks are trained on the sample's residuals (vector minus centroid), one for each
  group of components; a chunk becomes one byte per group. A search reads these codes, not vectors.
* A block of codes is looked up in the codebooks and scored against all queries of a cell by one
  matrix product; each query keeps its ``depth`` best, and only these are scored exactly.
* ``list_values`` counts the values of every filtered attribute per list. A filtered query probes
  only lists that may hold a match, nearest first, until they cover the wanted share of its matches;
  if fewer than ``k`` hits come out, the rest of these lists is searched. Lists without a match are
  never read, so a strict filter costs less than none, and no query rescans the table.
* ``tune`` sets share and depth on a sample of the queries for a wanted recall.

Lists and query batches are cut into cells of bounded size, so a list of any length, and memory per
task, are bounded. Vectors that cannot be compared are in no list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.operators.ivf import BLOCK_SCORES, nearest_ids, train_centroids, training_sample
from askgrid.operators.vector_topk import (DECIMALS, FILTERS, SLAB_ROWS, _Batch, _output, _ranked,
                                           _TopK, _used_filters, attach_facts, cells, scope_column,
                                           topk_cosine, unit_rows)
from askgrid.plans.shared import written

MAX_LISTS = 16_384
GROUPS = 16
CODEWORDS = 256
#: Depths that ``tune`` tries, in multiples of k.
DEPTHS = (2, 3, 4, 5, 8, 12, 20, 40)
TUNING_QUERIES = 64
#: Rows that ``probe`` gives at a time: every one holds its query's vector.
PROBED_ROWS = 4_096


@dataclass(frozen=True)
class PqIndex:
    """``codes``: chunk_id, list_id, code and filter attributes; ``vectors``: chunk_id, embedding.

    ``values``: attribute, value, lists, counts (how many chunks of a list have that value).
    ``sizes``: chunks per list. ``share`` and ``depth`` are the search effort.
    """

    codes: DataFrame
    vectors: DataFrame
    values: DataFrame
    centroids: np.ndarray
    codebooks: np.ndarray
    sizes: np.ndarray
    share: float = 1.0
    depth: int = 100

    @property
    def n_lists(self) -> int:
        return len(self.centroids)


# --- training and encoding ------------------------------------------------------------------------

def _nearest_words(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest codeword of every point; only ``BLOCK_SCORES`` scores exist at a time."""
    out = np.empty(len(points), np.int64)
    step, half = max(1, BLOCK_SCORES // len(book)), (book**2).sum(axis=1) / 2
    for start in range(0, len(points), step):
        scores = points[start:start + step] @ book.T
        scores -= half
        out[start:start + step] = scores.argmax(axis=1)
    return out


def _lloyd(points: np.ndarray, words: int, rounds: int, seed: int) -> np.ndarray:
    """Codewords of a bounded sample; repeats where there are fewer different points."""
    rng = np.random.default_rng(seed)
    different = np.unique(points, axis=0)
    if len(different) <= words:
        return different[np.arange(words) % len(different)]
    book = different[rng.choice(len(different), words, replace=False)]
    for _ in range(rounds):
        owner = _nearest_words(points, book)
        counts = np.bincount(owner, minlength=words)
        sums = np.stack([np.bincount(owner, points[:, i], words)
                         for i in range(points.shape[1])], axis=1)
        book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
    return book


def _bounds(dimension: int, groups: int) -> list[int]:
    return [dimension * i // groups for i in range(groups + 1)]


def _train_codebooks(sample: DataFrame, centroids: np.ndarray, groups: int, rounds: int, seed: int
                     ) -> np.ndarray:
    """``[codeword, component]``; group g holds components ``_bounds[g]`` to ``_bounds[g + 1]``.

    Each group of components is one task over the bounded sample.
    """
    dimension = centroids.shape[1]
    bounds, unit = _bounds(dimension, groups), _directions(centroids)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column(0), dimension)
            rows = rows[np.isfinite(rows).all(axis=1)]
            rows = rows - centroids[nearest_ids(rows, unit, 1)[:, 0]]
            for g in range(groups):
                part = rows[:, bounds[g]:bounds[g + 1]]
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array([g] * len(part), pa.int32()),
                    "part": pa.array(list(part), pa.list_(pa.float64()))})

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        points = np.stack(pdf["part"].to_list())
        points = points[np.lexsort(points.T)]  # the same order in every run
        book = _lloyd(points, CODEWORDS, rounds, seed + g)
        return pd.DataFrame({"g": g, "book": [book.ravel()]})

    books = (sample.select("unit").mapInArrow(residuals, "g int, part array<double>")
             .groupBy("g").applyInPandas(train, "g int, book array<double>").collect())
    out = np.zeros((CODEWORDS, dimension))
    for row in books:
        low, high = bounds[row["g"]], bounds[row["g"] + 1]
        out[:, low:high] = np.reshape(row["book"], (CODEWORDS, high - low))
    return out


def _directions(centroids: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(centroids, axis=1, keepdims=True)
    return centroids / np.where(norms > 0, norms, 1.0)


def encode(rows: np.ndarray, lists: np.ndarray, centroids: np.ndarray, codebooks: np.ndarray,
           groups: int) -> np.ndarray:
    """One byte per group of components: the codeword nearest to the residual."""
    bounds = _bounds(centroids.shape[1], groups)
    residual = rows - centroids[lists]
    out = np.empty((len(rows), groups), np.uint8)
    for g in range(groups):
        book = codebooks[:, bounds[g]:bounds[g + 1]]
        part = residual[:, bounds[g]:bounds[g + 1]]
        out[:, g] = _nearest_words(part, book)
    return out


def decode(codes: np.ndarray, centroid: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, looked up in the codebooks."""
    bounds = _bounds(codebooks.shape[1], codes.shape[1])
    out = np.empty((len(codes), codebooks.shape[1]))
    for g in range(codes.shape[1]):
        out[:, bounds[g]:bounds[g + 1]] = codebooks[codes[:, g], bounds[g]:bounds[g + 1]]
    return out + centroid


def encode_chunks(chunks: DataFrame, centroids: np.ndarray, codebooks: np.ndarray, groups: int
                  ) -> DataFrame:
    """``chunk_id, list_id, code`` and the filter attributes of all chunks that can be compared."""
    kept = [f for f in FILTERS if f in chunks.columns]
    rows = chunks.select("embedding", "chunk_id", *kept)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shared = chunks.sparkSession.sparkContext.broadcast((centroids, codebooks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books = shared.value
        unit = _directions(coarse)
        for batch in batches:
            matrix = unit_rows(batch.column(0), coarse.shape[1])
            usable = np.isfinite(matrix).all(axis=1)
            matrix, batch = matrix[usable], batch.filter(pa.array(usable))
            lists = nearest_ids(matrix, unit, 1)[:, 0]
            codes = encode(matrix, lists, coarse, books, groups)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(lists),
                 pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["chunk_id", *kept, "list_id", "code"])

    return rows.mapInArrow(
        run, ", ".join([*(f"{c} {types[c]}" for c in ("chunk_id", *kept)),
                        "list_id int", "code binary"]))


def list_values(codes: DataFrame) -> DataFrame:
    """``attribute, value, lists, counts``: the lists that hold a value, and how many chunks there.

    One row per value and at most one entry per list in it.
    """
    used = [f for f in FILTERS if f in codes.columns]
    if not used:
        return codes.sparkSession.createDataFrame(
            [], "attribute string, value string, lists array<int>, counts array<bigint>")
    pairs = F.array(*[F.struct(F.lit(f).alias("attribute"),
                               F.col(f).cast("string").alias("value")) for f in used])
    counted = (
        codes.select("list_id", F.inline(pairs)).where("value is not null")
        .groupBy("attribute", "value", "list_id").agg(F.count(F.lit(1)).alias("n")))
    packed = F.sort_array(F.collect_list(F.struct("list_id", "n")))
    return counted.groupBy("attribute", "value").agg(packed.alias("p")).select(
        "attribute", "value", F.col("p.list_id").alias("lists"), F.col("p.n").alias("counts"))


def default_lists(rows: int) -> int:
    """Lists grow with the square root of the table."""
    return max(1, min(MAX_LISTS, int(np.ceil(np.sqrt(rows)))))


def build_pq(chunks: DataFrame, n_lists: int | None = None, groups: int = GROUPS, rounds: int = 8,
             seed: int = 7) -> PqIndex:
    """An index over all ``chunks`` (``chunk_id, embedding`` and filter attributes).

    Centroids and codebooks come from at most about ``TRAIN_ROWS`` rows; every chunk is encoded.
    The driver sees centroids, codebooks and one count per list. Vectors without direction or of
    another length than most are in no list; an empty table gives an index that finds nothing.
    """
    sample = training_sample(chunks)
    known = sample.count()
    wanted = min(n_lists or default_lists(chunks.count()), MAX_LISTS, max(1, known // 4))
    centroids = train_centroids(sample, wanted, seed) if known else np.zeros((1, 1))
    groups = min(groups, centroids.shape[1])
    codebooks = _train_codebooks(sample, centroids, groups, rounds, seed)
    codes = written(encode_chunks(chunks, centroids, codebooks, groups)
                    .hint("rebalance", "list_id"))
    return _index(codes, chunks.select("chunk_id", "embedding"), written(list_values(codes)),
                  centroids, codebooks)


def _index(codes, vectors, values, centroids, codebooks) -> PqIndex:
    sizes = np.zeros(len(centroids), np.int64)
    for row in codes.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[row["list_id"]] = row["n"]
    return PqIndex(codes, vectors, values, centroids, codebooks, sizes)


def write_pq(index: PqIndex, path: str) -> None:
    """Store an index: codes in files sorted by list, so that row groups of other lists are skipped."""
    spark = index.codes.sparkSession
    (index.codes.repartitionByRange("list_id", "chunk_id").sortWithinPartitions("list_id")
     .write.mode("overwrite").parquet(f"{path}/codes"))
    index.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    index.values.write.mode("overwrite").parquet(f"{path}/values")
    rows = [(name, i, [float(x) for x in v])
            for name, table in (("centroid", index.centroids), ("codeword", index.codebooks))
            for i, v in enumerate(table)]
    spark.createDataFrame(rows, "kind string, id int, vector array<double>").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/trained")


def read_pq(spark: SparkSession, path: str) -> PqIndex:
    trained = spark.read.parquet(f"{path}/trained").orderBy("id")

    def table(kind: str) -> np.ndarray:
        return np.array([r["vector"] for r in trained.where(F.col("kind") == kind).collect()])

    return _index(spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"),
                  spark.read.parquet(f"{path}/values"), table("centroid"), table("codeword"))


# --- search -------------------------------------------------------------------------------------

def _eligible(queries: DataFrame, index: PqIndex, filters: list[str]) -> DataFrame:
    """Queries with ``lists, counts``: where matches may be, and how many at most; null for all."""
    nothing = F.lit(None)
    if not filters:
        return queries.withColumn("lists", nothing.cast("array<int>")).withColumn(
            "counts", nothing.cast("array<bigint>"))
    wanted = F.filter(F.array(*[
        F.struct(F.lit(f).alias("attribute"),
                 F.array_distinct(F.col(scope_column(f)).cast("array<string>")).alias("values"))
        for f in filters]), lambda s: F.size(s["values"]) > 0)
    asked = queries.select("query_id", F.size(wanted).alias("asked"), F.explode(wanted).alias("s"))
    per_list = (
        asked.select("query_id", "asked", "s.attribute", F.explode("s.values").alias("value"))
        .join(index.values, ["attribute", "value"])
        .select("query_id", "asked", "attribute", F.explode(F.arrays_zip("lists", "counts"))
                .alias("p"))
        .groupBy("query_id", "asked", "attribute", F.col("p.lists").alias("list_id"))
        .agg(F.sum("p.counts").alias("n"))
        # All attributes must match: a list holds at most the least of their counts.
        .groupBy("query_id", "asked", "list_id")
        .agg(F.count(F.lit(1)).alias("met"), F.min("n").alias("n")).where("met = asked")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("list_id", "n"))).alias("p"))
        .select("query_id", F.col("p.list_id").alias("found"), F.col("p.n").alias("n")))
    limited = F.size(wanted) > 0
    return queries.join(per_list, "query_id", "left").select(
        *queries.columns,
        F.when(limited, F.coalesce("found", F.array().cast("array<int>"))).alias("lists"),
        F.when(limited, F.coalesce("n", F.array().cast("array<bigint>"))).alias("counts"))


def probe(queries: DataFrame, index: PqIndex, share: float, least: int) -> DataFrame:
    """``queries`` once per list to search: ``list_id, size, at, covered``.

    Lists that may hold matches, nearest first, until they cover ``share`` of the matches and at
    least ``least`` of them. ``size`` is the length of the list, ``at`` the share of the matches up
    to it, ``covered`` whether the query leaves out no list with matches.
    """
    filters = _used_filters(queries)
    rows = _eligible(queries, index, filters)
    rows = rows.select("query_vector", "lists", "counts", "query_id",
                       *[scope_column(f) for f in filters])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = rows.columns[3:]
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, sizes = shared.value
        filled = np.flatnonzero(sizes)
        for batch in batches:
            matrix = unit_rows(batch.column(0), centroids.shape[1])
            for row, (lists, counts) in enumerate(zip(batch.column(1), batch.column(2))):
                if not np.isfinite(matrix[row]).all():
                    continue
                lists, counts = lists.as_py(), counts.as_py()
                ids = filled if lists is None else np.array(lists, np.int64)
                n = sizes[ids] if lists is None else np.array(counts, np.int64)
                order = np.lexsort((ids, -np.round(centroids[ids] @ matrix[row], DECIMALS)))
                ids, n = ids[order], n[order]
                upto = np.cumsum(n)
                need = max(share * n.sum(), min(least, n.sum()))
                stop = int(np.searchsorted(upto, need - 1e-9)) + 1 if ids.size else 0
                ids, at = ids[:stop], upto[:stop] / max(n.sum(), 1)
                for start in range(0, len(ids), PROBED_ROWS):
                    some = ids[start:start + PROBED_ROWS]
                    part = batch.take(pa.array(np.full(len(some), row)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *part.columns[3:], pa.array(some, pa.int32()),
                         pa.array(sizes[some], pa.int64()),
                         pa.array(at[start:start + PROBED_ROWS], pa.float64()),
                         pa.array(np.full(len(some), stop >= n.size), pa.bool_())],
                        names=["query_vector", *kept, "list_id", "size", "at", "covered"])

    return rows.mapInArrow(run, ", ".join(
        [*(f"{c} {types[c]}" for c in ("query_vector", *kept)), "list_id int, size bigint",
         "at double, covered boolean"]))


def _scan_codes(index: PqIndex, probed: DataFrame, depth: int, slab_rows: int) -> DataFrame:
    """The ``depth`` best of every query by the vectors that codes stand for."""
    filters = _used_filters(probed)
    ddl, schema = _output(index.codes, probed)
    shared = probed.sparkSession.sparkContext.broadcast((index.centroids, index.codebooks))
    asked = probed.drop("size", "at", "covered")
    left, right, keys = cells(index.codes.select("chunk_id", "list_id", "code", *filters), asked,
                              "list_id", slab_rows)
    dimension = index.centroids.shape[1]

    def cell(part: pa.Table, batch: pa.Table) -> pa.Table:
        if not part.num_rows or not batch.num_rows:
            return schema.empty_table()
        centroids, books = shared.value
        centroid = centroids[part.column("_bucket")[0].as_py()]
        top = _TopK(_Batch(batch, filters), depth)
        for piece in part.to_batches(max_chunksize=8_192):
            codes = np.frombuffer(b"".join(piece.column("code").to_pylist()), np.uint8)
            rows = decode(codes.reshape(piece.num_rows, -1), centroid, books)
            offsets = np.arange(piece.num_rows + 1, dtype=np.int32) * dimension
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
            top.add(piece.append_column("embedding", vectors))
        return top.result(schema)

    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, ddl)
    return _ranked(partial, depth)


def _rescore(found: DataFrame, queries: DataFrame, index: PqIndex, k: int) -> DataFrame:
    """The ``k`` best of the candidates by their own vectors."""
    pairs = (
        attach_facts(found.select("query_id", "chunk_id"), index.vectors)
        .join(queries.select("query_id", "query_vector"), "query_id")
        .select("embedding", "query_vector", "query_id", "chunk_id"))
    ddl, _ = _output(index.vectors, queries)
    dimension = index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (unit_rows(batch.column(i), dimension) for i in (0, 1))
            scores = np.round(np.einsum("ij,ij->i", one, two), DECIMALS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), pa.array(scores)],
                names=["query_id", "chunk_id", "similarity"])

    return _ranked(pairs.mapInArrow(run, ddl), k)


def topk_pq(queries: DataFrame, index: PqIndex, k: int = 20, share: float | None = None,
            depth: int | None = None, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """``query_id, rank, chunk_id, cosine_distance, similarity``: about the k nearest per query.

    ``queries`` as for ``topk_cosine``, with ids that are keys. Similarities are exact, and so is
    the whole answer of a query with at most ``depth`` matches. A query with fewer than ``k`` hits
    has no further match anywhere.
    """
    share, depth = share or index.share, max(depth or index.depth, k)
    filters = _used_filters(queries)
    wanted = queries.select("query_id", "query_vector", *[scope_column(f) for f in filters])
    probed = written(probe(wanted, index, share, depth))
    found = written(_scan_codes(index, probed, depth, slab_rows))
    first = _rescore(found, wanted, index, k)
    if not filters:
        return first
    # Counts of several attributes are upper bounds, so the lists taken may hold too few matches.
    first = written(first)
    hits = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    starved = (
        probed.groupBy("query_id").agg(F.max("covered").alias("covered")).where("not covered")
        .join(hits, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id"))
    again = written(wanted.join(starved, "query_id", "left_semi"))
    if again.isEmpty():
        return first
    rest = written(probe(again, index, 1.0, depth))
    second = _rescore(_scan_codes(index, rest, depth, slab_rows), again, index, k)
    return first.join(again.select("query_id"), "query_id", "left_anti").unionByName(second)


def tune(queries: DataFrame, index: PqIndex, k: int = 20, target: float = 0.9,
         sample: int = TUNING_QUERIES) -> PqIndex:
    """``index`` with the least effort that reaches ``target`` on ``sample`` of the queries.

    Their exact answers are computed once. The share comes from the lists that hold true
    neighbours, the depth from the places these have by their codes; both are asked for a little
    more than the square root of the target, so that together they reach it. Counts per place
    (bounded by lists and depths) are all that is collected.
    """
    filters = _used_filters(queries)
    some = written(queries.select("query_id", "query_vector", *[scope_column(f) for f in filters])
                   .orderBy(F.xxhash64("query_id"), "query_id").limit(sample))
    attributes = index.codes.select("chunk_id", "list_id", *filters)
    exact = written(topk_cosine(some, index.vectors.join(
        attributes.drop("list_id"), "chunk_id") if filters else index.vectors, k))
    hits = exact.count()
    if not hits:
        return replace(index, share=1.0)
    each = (1 + np.sqrt(target)) / 2
    # The covered share at which the list of each true neighbour is reached.
    wanted = exact.select("query_id", "chunk_id").join(
        attributes.select("chunk_id", "list_id"), "chunk_id").join(
            probe(some, index, 1.0, 0).select("query_id", "list_id", "at"),
            ["query_id", "list_id"])
    share = wanted.agg(F.expr(f"percentile_disc({each}) within group (order by at)")).first()[0]
    deepest = max(DEPTHS) * k
    found = _scan_codes(index, probe(some, index, share, deepest), deepest,
                        SLAB_ROWS)
    at = (found.join(exact.select("query_id", "chunk_id"), ["query_id", "chunk_id"])
          .groupBy(F.ceil(F.col("rank") / k).alias("m")).agg(F.count(F.lit(1)).alias("n")))
    by_depth = {r["m"]: r["n"] for r in at.collect()}
    for depth in DEPTHS:
        if sum(n for m, n in by_depth.items() if m <= depth) >= each * target**0.5 * hits:
            break
    return replace(index, share=float(share), depth=depth * k)


def effort(queries: DataFrame, index: PqIndex) -> DataFrame:
    """``query_id, codes_read, vectors_read, chunks``: what a search of each query touches."""
    return probe(queries, index, index.share, index.depth).groupBy("query_id").agg(
        F.sum("size").alias("codes_read")).select(
            "query_id", "codes_read",
            F.least(F.lit(index.depth), F.col("codes_read")).cast("bigint").alias("vectors_read"),
            F.lit(int(index.sizes.sum())).cast("bigint").alias("chunks"))


__all__ = ["PqIndex", "build_pq", "decode", "default_lists", "effort", "encode", "encode_chunks",
           "list_values", "probe", "read_pq", "topk_pq", "tune", "write_pq"]
