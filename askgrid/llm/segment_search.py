"""Exact top-k by inner product, pruned with multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and deviation. For any two vectors

    q . x  <=  sum over segments of length * (mean_q * mean_x + deviation_q * deviation_x),

which is the same statement as the lower bound of their distance by segment means and deviations,
``|q - x|^2 = |q|^2 + |x|^2 - 2 q . x``. A task compares a block of queries with the vectors of its
cell. The exact scores of the vectors with the highest coarse bounds give each query a first
threshold. Then come the vectors, block by block: coarse segments rule out pairs, finer ones rule out
more of what is left, exact products decide among the survivors, and the k-th best score so far is
carried into the next block as the threshold.

Both sides are dealt to cells by hash, so cells have bounded sizes; each returns at most k rows per
query, and the best k of those are the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
SEGMENTS = (4, 16)
VECTOR_SLAB = 4_096
QUERY_SLAB = 4_096
BLOCK = 256
VECTOR_BLOCK = 512
#: Allowance for rounding in the bounds, relative to the largest components.
_SLACK = 1e-6
_LONG = np.iinfo(np.int64)


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner product bounds that of the vectors: scaled means, deviations, allowance."""
    d = vectors.shape[1]
    edges = np.linspace(0, d, min(segments, d) + 1).astype(int) if d else np.zeros(1, int)
    means, devs = [], []
    for lo, hi in zip(edges[:-1], edges[1:]):
        part, root = vectors[:, lo:hi], np.sqrt(hi - lo)
        means.append(part.mean(axis=1) * root)
        devs.append(part.std(axis=1) * root)
    if not means:
        return np.zeros((len(vectors), 1))
    return np.stack([*means, *devs, np.abs(vectors).max(axis=1) * np.sqrt(d) * _SLACK], axis=1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows; sums beyond doubles by Python integers.

    What even a long cannot hold counts as the nearest long.
    """
    large = np.abs(q).sum() * np.abs(x).max(axis=1, initial=0) >= 2.0**53
    score = np.where(large, 0, x @ q).astype(np.int64)
    for i in np.flatnonzero(large):
        whole = sum(int(a) * int(b) for a, b in zip(q, x[i]))
        score[i] = max(_LONG.min, min(_LONG.max, whole))
    return score


def _block_top(q: np.ndarray, q_stats: list, q_ids: np.ndarray, x: np.ndarray, x_stats: list,
               x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of the best k vectors (``x_ids`` ascending) of each query, their scores, and the
    number of exact products that took."""
    n = len(x)
    own = np.searchsorted(x_ids, q_ids)
    own = np.where((own < n) & (x_ids[np.minimum(own, n - 1)] == q_ids), own, -1)
    rows = cols = score = np.empty(0, np.int64)
    floor, products = np.full(len(q), -np.inf), 0
    if n > k + 1:
        bound = q_stats[0] @ x_stats[0].T
        has_own = np.flatnonzero(own >= 0)
        bound[has_own, own[has_own]] = -np.inf
        first = np.argpartition(bound, n - k, axis=1)[:, n - k:]
        reach = np.abs(q).max(axis=1, initial=0) * np.abs(x).max(initial=0) * q.shape[1] * _SLACK**2
        floor = np.einsum("qd,qkd->qk", q, x[first]).min(axis=1) - reach
        # Beyond longs scores tie at the ends.
        floor = np.where(floor <= _LONG.min, -np.inf, np.minimum(floor, 2.0**63 - 2048))
        products = first.size
    for lo in range(0, n, VECTOR_BLOCK):
        block = slice(lo, lo + VECTOR_BLOCK)
        alive = np.ones((len(q), len(x[block])), bool)
        here = np.flatnonzero((own >= lo) & (own < lo + VECTOR_BLOCK))
        alive[here, own[here] - lo] = False
        # Scores are whole numbers: half a step below the threshold nothing can reach it.
        for of_q, of_x in zip(q_stats, x_stats):
            a, b = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            alive[np.ix_(a, b)] &= of_q[a] @ of_x[block][b].T >= (floor[a] - 0.5)[:, None]
        r, c = np.nonzero(alive)
        if not r.size:
            continue
        asking, start = np.unique(r, return_index=True)
        found = np.concatenate([
            _exact(q[i], x[block][places]) for i, places in zip(asking, np.split(c, start[1:]))])
        products += found.size
        best = found >= floor[r] - 0.5
        rows, cols = np.concatenate([rows, r[best]]), np.concatenate([cols, c[best] + lo])
        score = np.concatenate([score, found[best]])
        order = np.lexsort((cols, -1 - score, rows))  # ~score: no overflow at the least long
        rows, cols, score = rows[order], cols[order], score[order]
        place = np.arange(rows.size) - np.searchsorted(rows, rows)
        best = place < k
        rows, cols, score, place = rows[best], cols[best], score[best], place[best]
        last = place == k - 1
        floor[rows[last]] = np.maximum(floor[rows[last]], score[last])
    return rows, cols, score, products


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending, each once (the smallest of its vectors), and their rows."""
    ids = frame["vec_id"].to_numpy(np.int64)
    vectors = np.stack(frame["vector"].to_numpy()).astype(np.float64).reshape(len(ids), -1)
    order = np.lexsort((*vectors.T[::-1], ids)) if vectors.shape[1] else np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = ids[1:] != ids[:-1]
    return ids[fresh], vectors[fresh]


def _cell(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        q_ids, q = _matrix(queries)
        x_ids, x = _matrix(vectors)
        q_stats = [segment_statistics(q, s) for s in SEGMENTS]
        x_stats = [segment_statistics(x, s) for s in SEGMENTS]
        out = []
        for lo in range(0, len(q), BLOCK):
            part = slice(lo, lo + BLOCK)
            rows, cols, score, _ = _block_top(
                q[part], [s[part] for s in q_stats], q_ids[part], x, x_stats, x_ids, k)
            out.append(pd.DataFrame({"query_id": q_ids[part][rows], "vec_id": x_ids[cols],
                                     "score": score}))
        return pd.concat(out)

    return run


def _slab(of: str, slabs: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(slabs)).cast("int")


def topk_inner(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = K,
    vector_slab: int = VECTOR_SLAB,
    query_slab: int = QUERY_SLAB,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products.

    Both tables have ``vec_id`` and ``vector`` (whole numbers as doubles, no nulls inside). A query
    is not compared with the vector of its own id, nor with vectors of another length. Ties go to
    the smaller id. Of rows repeated with one id, the smallest vector counts, once. Scores are exact
    whatever their size; one that a long cannot hold counts as the nearest long.
    """
    vector_slabs = max(1, -(-vectors.count() // vector_slab))
    query_slabs = max(1, -(-queries.count() // query_slab))

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    size = F.size("vector").alias("size")
    left = queries.select("vec_id", "vector", size, _slab("vec_id", query_slabs).alias("q"),
                          all_of(vector_slabs).alias("x"))
    right = vectors.select("vec_id", "vector", size, all_of(query_slabs).alias("q"),
                           _slab("vec_id", vector_slabs).alias("x"))
    cell = ["size", "q", "x"]
    best = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
        _cell(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
              scale: int = SCALE) -> DataFrame:
    """``vec_id, vector`` with components ``floor(scale * x)``.

    Rows with a null id, a null vector, or a null or non-finite component are left out.
    """
    v = F.col(vector_col)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(
        F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(usable, F.lit(False))
    ).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"))


def topk_embeddings(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """Top k of all rows for the stated query set: rows whose id is divisible by ``every``."""
    vectors = quantised(embeddings)
    return topk_inner(vectors.where(F.col("vec_id") % every == 0), vectors, k)
