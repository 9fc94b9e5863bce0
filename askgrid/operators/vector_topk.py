"""Exact cosine top-k for query batches, with per-query filters applied before ranking.

Two exact plans share one kernel:

* a query batch below ``broadcast_bytes`` is sent to every task, which scans its chunk partition
  once and keeps k rows per query: chunk vectors are never shuffled;
* a larger batch is cut into cells: chunks and queries are hashed into slabs of bounded size and
  each (bucket, chunk slab, query slab) cell is one task. The bucket is constant for a full scan
  and the list id for the approximate index, so a list holding most vectors is split as well.

Only k rows per query and task leave the kernel; the final rank window therefore sorts at most
k rows per (query, task).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.plans.shared import written

# Similarities closer than this count as ties and are ordered by chunk id: block products are
# not bit-reproducible across block sizes.
DECIMALS = 12
FILTERS = ("knowledge_base_id", "document_id", "document_format", "parser_name", "section",
           "page_number")
BROADCAST_BYTES = 64 * 1024 * 1024
SLAB_ROWS = 50_000
#: Scans of more tasks than this merge their rows per query in two steps.
ONE_STEP_TASKS = 256
MERGE_SHARDS = 64
#: Scores held at a time in a task, and queries they are for at most.
BLOCK_SCORES = 1 << 19
BLOCK_QUERIES = 1_024


def scope_column(attribute: str) -> str:
    """Name of the query column holding the allowed values of a chunk attribute."""
    return f"scope_{attribute}"


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    """Vectors as rows; a null vector, another length or a null component gives a row of NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fits = lengths == dimension
    if not fits.all():
        column = column.filter(pa.array(fits))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    out = np.full((len(fits), dimension), np.nan)
    out[fits] = flat.reshape(-1, dimension)
    return out


def _unit(matrix: np.ndarray) -> np.ndarray:
    if not matrix.size:
        return matrix
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / norms


def unit_rows(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    """Vectors scaled to length 1 as rows; those that cannot be compared are rows of NaN."""
    return _unit(_matrix(column, dimension))


class _Batch:
    """A query batch: unit vectors in groups that share one filter and one dimension.

    Queries without a usable vector belong to no group and get no rows.
    """

    def __init__(self, table: pa.Table, filters: Sequence[str]):
        self.ids = np.asarray(table.column("query_id").to_numpy())
        self.filters = list(filters)
        vectors = table.column("query_vector").combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        scopes = [table.column(scope_column(f)).to_pylist() for f in filters]
        self.groups: list[tuple[tuple, int, np.ndarray, np.ndarray]] = []
        for dimension in sorted({int(n) for n in lengths} - {0}):
            matrix = _unit(_matrix(vectors, dimension))
            usable = np.isfinite(matrix).all(axis=1)
            groups: dict[tuple, list[int]] = {}
            for row in np.flatnonzero((lengths == dimension) & usable):
                key = tuple(tuple(s[row] or ()) for s in scopes)
                groups.setdefault(key, []).append(row)
            self.groups += [(key, dimension, np.asarray(rows), matrix[rows])
                            for key, rows in groups.items()]


class _Attribute:
    """One chunk attribute of a block, coded so that a filter is a table lookup."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        codes, self.values = pd.factorize(np.asarray(column.to_pylist(), dtype=object))
        self.codes = codes

    def among(self, allowed: tuple) -> np.ndarray:
        wanted = set(allowed)
        flags = np.fromiter((v in wanted for v in self.values), bool, len(self.values))
        return np.append(flags, False)[self.codes]  # code -1 (null) matches nothing


class _TopK:
    """Running k best chunks of every query, as flat arrays sorted by query."""

    def __init__(self, batch: _Batch, k: int):
        self.batch, self.k = batch, k
        self.rows: np.ndarray | None = None
        self.scores: np.ndarray | None = None
        self.ids: np.ndarray | None = None
        self.floors = np.full(len(batch.ids), -np.inf)

    def add(self, block: pa.Table | pa.RecordBatch) -> None:
        if not block.num_rows:
            return
        ids = np.asarray(pa.array(block.column("chunk_id").to_pylist()).to_numpy(
            zero_copy_only=False))
        by_dimension = {}
        for dimension in {group[1] for group in self.batch.groups}:
            vectors = _unit(_matrix(block.column("embedding"), dimension))
            by_dimension[dimension] = vectors, np.isfinite(vectors).all(axis=1)
        # Scores of few rows at a time, but of enough that most are ruled out before a merge.
        queries = min(BLOCK_QUERIES, max((len(g[2]) for g in self.batch.groups), default=1))
        step = max(self.k, BLOCK_SCORES // queries)
        attributes = {f: _Attribute(block.column(f)) for f in self.batch.filters}
        for key, dimension, rows, matrix in self.batch.groups:
            vectors, mask = by_dimension[dimension]
            for name, allowed in zip(self.batch.filters, key, strict=True):
                if allowed:
                    mask = mask & attributes[name].among(allowed)
            if not mask.any():
                continue
            some_ids, some_vectors = ids[mask], vectors[mask]
            for start in range(0, len(some_ids), step):
                part_ids, part = some_ids[start:start + step], some_vectors[start:start + step]
                hits = [self._hits(rows[at:at + BLOCK_QUERIES], matrix[at:at + BLOCK_QUERIES],
                                   part_ids, part) for at in range(0, len(rows), BLOCK_QUERIES)]
                self._merge(*(np.concatenate(column) for column in zip(*hits)))

    def _hits(self, rows: np.ndarray, matrix: np.ndarray, ids: np.ndarray, vectors: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, scores and ids that may be among the ``k`` best, ties with the last one included."""
        scores = matrix @ vectors.T
        np.round(scores, DECIMALS, out=scores)
        cut = max(scores.shape[1] - self.k, 0)
        floors = np.partition(scores, cut, axis=1)[:, cut]
        hit_rows, hit_columns = np.nonzero(
            scores >= np.maximum(floors, self.floors[rows])[:, None])
        return rows[hit_rows], scores[hit_rows, hit_columns], ids[hit_columns]

    def _merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        if self.rows is not None:
            rows = np.concatenate([self.rows, rows])
            scores = np.concatenate([self.scores, scores])
            ids = np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        first = np.searchsorted(rows, rows, side="left")
        place = np.arange(len(rows)) - first
        keep = place < self.k
        self.rows, self.scores, self.ids = rows[keep], scores[keep], ids[keep]
        # A query that has k rows needs no score below the last of them.
        last = place == self.k - 1
        self.floors[rows[last]] = scores[last]

    def result(self, schema: pa.Schema) -> pa.Table:
        if self.rows is None:
            return schema.empty_table()
        columns = [self.batch.ids[self.rows], self.ids, self.scores]
        return pa.table(
            [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
            schema=schema,
        )


def _output(chunks: DataFrame, queries: DataFrame) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [
        ("query_id", queries.schema["query_id"].dataType),
        ("chunk_id", chunks.schema["chunk_id"].dataType),
    ]
    ddl = ", ".join(f"{n} {t.simpleString()}" for n, t in fields) + ", similarity double"
    arrow = pa.schema([(n, to_arrow_type(t)) for n, t in fields] + [("similarity", pa.float64())])
    return ddl, arrow


def _ranked(partial: DataFrame, k: int, shards: int = 1) -> DataFrame:
    """The best k per query; with ``shards``, per query and shard first, so that no task merges
    the rows of all scan tasks for a query."""
    order = [F.col("similarity").desc(), F.col("chunk_id")]
    if shards > 1:
        shard = Window.partitionBy("query_id", "_shard").orderBy(*order)
        partial = (
            partial.withColumn("_shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)))
            .withColumn("rank", F.row_number().over(shard)).where(F.col("rank") <= k)
            .drop("_shard", "rank")
        )
    best = Window.partitionBy("query_id").orderBy(*order)
    return (
        partial.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("cosine_distance", 1.0 - F.col("similarity"))
        .select("query_id", "rank", "chunk_id", "cosine_distance", "similarity")
    )


def _used_filters(queries: DataFrame) -> list[str]:
    return [f for f in FILTERS if scope_column(f) in queries.columns]


def scan_topk(chunks: DataFrame, batch: pa.Table, filters: Sequence[str], k: int,
              ddl: str, schema: pa.Schema) -> DataFrame:
    """One pass over the chunks with the whole (small) query batch in every task.

    Input splits stay as they are, so a lost task repeats one split. Every task emits k rows per
    query; if there are many tasks, these are merged in two steps.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(batch)
    many = chunks.rdd.getNumPartitions() > ONE_STEP_TASKS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _TopK(_Batch(shared.value, filters), k)
        for part in batches:
            top.add(part)
        yield from top.result(schema).to_batches(max_chunksize=10_000)

    return _ranked(chunks.mapInArrow(scan, ddl), k, MERGE_SHARDS if many else 1)


def cells(chunks: DataFrame, queries: DataFrame, bucket: str | None, slab_rows: int
          ) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt into cells of bounded size, and the columns that name a cell.

    Slab counts come from row counts per bucket (pre-aggregated); each side is copied once per
    slab of the other side, the least any exact comparison of both needs.
    """
    chunks, queries = (
        (chunks.withColumn("_bucket", F.lit(0)), queries.withColumn("_bucket", F.lit(0)))
        if bucket is None
        else (chunks.withColumnRenamed(bucket, "_bucket"),
              queries.withColumnRenamed(bucket, "_bucket"))
    )

    needed = F.ceil(F.count(F.lit(1)) / F.lit(slab_rows)).cast("bigint")
    if bucket is None:
        # One bucket: two numbers, no join.
        counts = {"_cn": chunks.agg(needed).scalar(), "_qn": queries.agg(needed).scalar()}

        def sized(df: DataFrame) -> DataFrame:
            return df.withColumns(counts)
    else:
        # At most one row per list; the index limits the number of lists.
        sizes = F.broadcast(
            chunks.groupBy("_bucket").agg(needed.alias("_cn")).join(
                queries.groupBy("_bucket").agg(needed.alias("_qn")), "_bucket")
        )

        def sized(df: DataFrame) -> DataFrame:
            return df.join(sizes, "_bucket")

    def place(df: DataFrame, key: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        return (
            sized(df)
            .withColumn(mine, F.pmod(F.xxhash64(key), F.col(own)))
            .withColumn(
                theirs,
                # No copies at all where the other side is empty.
                F.explode(F.when(F.col(other) > 0,
                                 F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))),
            )
            .drop("_cn", "_qn")
        )

    left = place(chunks, "chunk_id", "_cn", "_qn", "_cs", "_qs")
    right = place(queries, "query_id", "_qn", "_cn", "_qs", "_cs")
    return left, right, ["_bucket", "_cs", "_qs"]


def cell_topk(chunks: DataFrame, queries: DataFrame, k: int, bucket: str | None = None,
              slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Top-k by cells of bounded size; with ``bucket``, only equal buckets are compared."""
    filters = _used_filters(queries)
    ddl, schema = _output(chunks, queries)
    left, right, keys = cells(chunks, queries, bucket, slab_rows)

    def cell(part: pa.Table, batch: pa.Table) -> pa.Table:
        if not part.num_rows or not batch.num_rows:
            return schema.empty_table()
        top = _TopK(_Batch(batch, filters), k)
        for piece in part.to_batches(max_chunksize=8_192):
            top.add(piece)
        return top.result(schema)

    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, ddl)
    return _ranked(partial, k)


def topk_cosine(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 20,
    broadcast_bytes: int = BROADCAST_BYTES,
    slab_rows: int = SLAB_ROWS,
) -> DataFrame:
    """``(query_id, rank, chunk_id, cosine_distance, similarity)``, the k nearest per query.

    ``queries``: ``query_id, query_vector`` and optional ``scope_<attribute>`` arrays (empty or
    null = no restriction); ``chunks``: ``chunk_id, embedding`` and the filtered attributes.
    The batch size is counted before deciding whether to send it to every task, which is a choice
    of plan only. Vectors of another length than the query's, null or non-finite ones and those
    without direction are not ranked, and such queries get no rows: ``vector_violations`` lists
    them.
    """
    filters = _used_filters(queries)
    chunks = chunks.select("chunk_id", "embedding", *filters)
    queries = queries.select(
        "query_id", "query_vector", *[scope_column(f) for f in filters]
    )
    arrays = [F.size("query_vector")] + [
        F.greatest(F.size(scope_column(f)), F.lit(0)) for f in filters
    ]
    cells: Column = arrays[0]
    for extra in arrays[1:]:
        cells = cells + extra
    size = queries.agg(F.coalesce(F.sum(cells + 1), F.lit(0)).alias("n")).first()["n"] * 8
    if size > broadcast_bytes:
        return cell_topk(chunks, queries, k, slab_rows=slab_rows)
    ddl, schema = _output(chunks, queries)
    return scan_topk(chunks, queries.toArrow(), filters, k, ddl, schema)


def vector_violations(df: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """``key, code`` of rows whose vector cannot be compared in an index of ``dimension``.

    Codes: ``vector_missing``, ``dimension_mismatch``, ``not_finite`` (a null, NaN or infinite
    component), ``zero_norm``.
    """
    v = F.col(vector)
    infinite = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    code = (
        F.when(v.isNull(), "vector_missing")
        .when(F.size(v) != dimension, "dimension_mismatch")
        .when(F.coalesce(infinite, F.lit(True)), "not_finite")
        .when(F.forall(v, lambda x: x == 0), "zero_norm")
    )
    return df.select(key, code.alias("code")).where("code is not null")


def attach_facts(found: DataFrame, facts: DataFrame, rows: int | None = None) -> DataFrame:
    """Candidates with the facts of their chunks, without moving the chunk table.

    ``found`` holds at most k rows per query. It is written once, its rows are counted, and up to
    ``rows`` of them (64 MiB at 128 bytes) go to every task that scans ``facts``; a larger answer
    joins by shuffle. Both ways give the same rows.
    """
    found = written(found)
    most = BROADCAST_BYTES // 128 if rows is None else rows
    small = found.count() <= most
    return facts.join(F.broadcast(found) if small else found, "chunk_id")
