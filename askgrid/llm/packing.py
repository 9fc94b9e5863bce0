"""Packing by cutting-stock column generation over a length histogram.

Every document becomes pieces: as many full sequences as fit, and a rest. Piece lengths are counted
in classes whose width grows with the length, exact up to 64 tokens and ``unit`` tokens at most, so
that a class overstates its pieces by less than a thirtieth; their counts are all the driver sees
(``capacity / unit`` and about a hundred more numbers at most).
A linear program over patterns (how many pieces of each class share a sequence) is solved by column
generation: the dual prices of the classes go into an unbounded knapsack, solved by dynamic
programming, whose best pattern enters the basis until none is worth more than one sequence. The
patterns are rounded down and what they leave over, some pieces per pattern, is packed greedily.
Ranked pieces then look up their sequence in the table of patterns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.encoding import encoder, slices, tidy
from askgrid.plans.shared import written

CAPACITY = 4096
UNIT = 16
#: Length up to which classes are exact.
EXACT = 64
#: A pattern worth this little more than a sequence ends the program: it is within that share of the
#: least number of sequences.
GAP = 5e-4
#: Pivots after which the linear program stops improving; its patterns hold every piece all the same,
#: at worst with more padding.
MOST_PIVOTS = 20_000
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "class int, part bigint, local_rank bigint")


# --- the linear program (driver; as many sizes as classes) -------------------------------------

def class_of(length: np.ndarray, unit: int) -> np.ndarray:
    """The length rounded up to its class: steps of 1 up to ``EXACT``, then 2, 4 ... ``unit``."""
    out, step = np.array(length, np.int64), 1
    while step < unit:
        step *= 2
        wide = length > EXACT * step // 2
        out[wide] = -(-length[wide] // min(step, unit)) * min(step, unit)
    return out


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: how many of each item give the highest value within ``capacity``.

    Items enter one by one, small ones first; one that smaller ones already beat at its own size is
    passed over. With sizes counted in rows of an item's size, the best of a column is a
    running maximum, so an item costs one pass over all rooms.
    """
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for i in np.argsort(sizes, kind="stable"):
        size = int(sizes[i])
        if size > capacity or values[i] <= best[size] + 1e-12:
            continue
        rows = -(-(capacity + 1) // size)
        grid = np.full(rows * size, -np.inf)
        grid[:capacity + 1] = best
        climb = (np.arange(rows) * values[i])[:, None]
        grid = (np.maximum.accumulate(grid.reshape(rows, size) - climb, axis=0) + climb).ravel()
        grid = grid[:capacity + 1]
        better = grid > best + 1e-12
        best[better], taken[better] = grid[better], i
    counts, room = np.zeros(sizes.size), int(np.argmax(best))
    while taken[room] >= 0:
        counts[taken[room]] += 1
        room -= int(sizes[taken[room]])
    return counts


def solve_patterns(demand: np.ndarray, sizes: np.ndarray, capacity: int):
    """``(patterns, multiplicities)`` of a basic solution of the covering linear program."""
    n = sizes.size
    basis = np.diag(np.floor(capacity / sizes))
    inverse = np.diag(1.0 / np.diag(basis))
    cost = np.ones(n)
    amount = inverse @ demand
    for _ in range(MOST_PIVOTS):
        prices = cost @ inverse
        worst = int(np.argmin(prices))
        if prices[worst] < -1e-9:  # covering more than asked for is allowed, at no cost
            column, price = np.zeros(n), 0.0
            column[worst] = -1.0
        else:
            column, price = best_pattern(np.maximum(prices, 0), sizes, capacity), 1.0
            if prices @ column <= 1.0 + GAP:
                break
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(n, np.inf)
        ratio[up] = np.maximum(amount[up], 0) / step[up]
        out = int(np.argmin(ratio))
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        basis[:, out], cost[out] = column, price
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    used = cost > 0
    return basis[:, used].T, np.maximum(amount[used], 0)


def plan_sequences(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """``(pieces per class, number of sequences)``: whole patterns that hold every piece."""
    classes = sorted((c for c, n in histogram.items() if n > 0), reverse=True)
    if not classes:
        return []
    sizes = np.array(classes)
    left = np.array([histogram[c] for c in classes], np.int64)
    patterns, times = solve_patterns(left.astype(float), sizes, room)
    plan = []
    for pattern, amount in zip(patterns, np.floor(times + 1e-9).astype(np.int64)):
        counts = np.rint(pattern).astype(np.int64)
        if amount > 0:
            plan.append(({int(c): int(k) for c, k in zip(sizes, counts) if k}, int(amount)))
            left = left - counts * amount
    left = np.maximum(left, 0)
    while left.any():  # first fit by falling size; repeats of one filling are taken at once
        free, counts = room, np.zeros_like(left)
        for i, size in enumerate(sizes):
            counts[i] = min(left[i], free // size)
            free -= counts[i] * size
        held = counts > 0
        times_now = int(np.min(left[held] // counts[held]))
        plan.append(({int(c): int(k) for c, k in zip(sizes, counts) if k}, times_now))
        left = left - counts * times_now
    return plan


# --- pieces -----------------------------------------------------------------------------------

def _pieces(file: str, end_id: int, capacity: int, unit: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(file), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, size in slices(batch.column(1)):
                out = enc.ids(batch.column(1).slice(first, size))
                ids = np.ascontiguousarray(np.insert(out.ids, out.offsets[1:], end_id), "<u4")
                offsets = out.offsets + np.arange(size + 1)
                tokens = np.diff(offsets)
                number = -(-tokens // capacity)
                doc = np.repeat(np.arange(size), number)
                place = np.arange(doc.size) - np.repeat(np.cumsum(number) - number, number)
                start = place * capacity
                length = np.minimum(tokens[doc] - start, capacity)
                lo = offsets[doc] + start
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(lo, lo + length)]
                kind = class_of(length, unit)
                order = np.argsort(kind, kind="stable")
                counts = np.bincount(kind, minlength=seen.size)
                rank = np.empty(doc.size, np.int64)
                rank[order] = np.arange(doc.size) - np.repeat(np.cumsum(counts) - counts, counts)
                rank += seen[kind]
                seen += counts
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, size).take(pa.array(doc)), pa.array(start),
                     pa.array(length), pa.array(sums, pa.int64()), pa.array(tokens[doc]),
                     pa.array(kind.astype(np.int32)), pa.array(np.full(doc.size, part, np.int64)),
                     pa.array(rank)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class",
                           "part", "local_rank"])

    return run


def pack_documents(
    docs: DataFrame,
    file: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    unit: int = UNIT,
) -> DataFrame:
    """One row per piece: where it comes from and where it lies.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length``: ids
    ``start .. start + length`` of the document (its ids and ``end_id``) lie at ``offset`` of
    sequence ``sequence_id``. ``padded_length`` is the sequence's length with padding: its own
    where that is a power of two, else ``capacity``. Null text counts as empty and gives the end id
    alone; repeated rows are packed each; a null id is kept. Only the two named columns are read.
    An empty table gives no rows.
    """
    if capacity % unit:
        raise ValueError("unit must divide capacity")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Written once: texts are encoded a single time, and ranks inside parts stay what they were.
    pieces = written(rows.mapInArrow(_pieces(file, end_id, capacity, unit), PIECES))
    per_part = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["class"]: r["n"] for r in per_part.groupBy("class").agg(
        F.sum("n").alias("n")).collect()}  # one row per class
    plan = plan_sequences(histogram, capacity)

    slots, base, used = [], 0, dict.fromkeys(histogram, 0)
    for counts, times in plan:
        for kind, each in counts.items():
            slots.append((kind, used[kind], used[kind] + each * times, each, base))
            used[kind] += each * times
        base += times
    # At most (patterns x classes in one) rows: bounded by capacity and unit, not by the data.
    table = docs.sparkSession.createDataFrame(
        slots, "class int, low bigint, high bigint, each bigint, base bigint")

    before = Window.partitionBy("class").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_rank"))
    ranked = pieces.join(offsets, ["class", "part"]).withColumn(
        "rank", F.col("offset_rank") + F.col("local_rank"))
    placed = ranked.join(
        F.broadcast(table),
        (ranked["class"] == table["class"]) & (ranked["rank"] >= table["low"])
        & (ranked["rank"] < table["high"]),
    ).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", ranked["class"],
        (F.col("base") + F.expr("(rank - low) div each")).alias("sequence_id"))
    whole = Window.partitionBy("sequence_id")
    upto = whole.orderBy(F.col("class").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.sum("length").over(whole)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(upto), F.lit(0)).alias("offset"),
        F.when(filled.bitwiseAND(filled - 1) == 0, filled).otherwise(
            F.lit(capacity).cast("bigint")).alias("padded_length"))
