"""Document fingerprints: bottom-k sketches of word shingle hashes, as plain column expressions.

A sketch is the ascending array of the ``K`` smallest different shingle hashes of a text. Sketches
of parts merge into the sketch of the whole, and two sketches estimate resemblance, containment and
the number of different shingles. Everything runs inside the JVM; a document never leaves its row.

The following document of each one is found without sorting the table in one place: documents are
cut into ranges of ids, the first document of a range is also sent to the range before, and a window
inside each range does the rest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
RANGE_ROWS = 500
MOST_CUTS = 50_000
_LOWEST = -(2**63)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of ``words`` words; a shorter text is one shingle, an empty one none."""

    def of(parts: Column) -> Column:
        last = F.size(parts) - words
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(parts, i + j) for j in range(words)]))
        return F.when(F.size(parts) > 0, runs).otherwise(F.array().cast("array<bigint>"))

    split = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    # Bound once per row: a lambda over a one-element array is evaluated a single time.
    return F.get(F.transform(F.array(split), of), 0)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The bottom-k sketch of a text; null counts as empty."""
    hashes = shingle_hashes(F.coalesce(text, F.lit("")), words)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge_sketches(first: Column, second: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return F.slice(F.sort_array(F.array_union(first, second)), 1, k)


def resemblance(first: Column, second: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets; exact if both have at most ``k``.

    Two empty sketches are alike (1), an empty and a filled one are not (0).
    """
    union = merge_sketches(first, second, k)
    common = F.array_intersect(union, F.array_intersect(first, second))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(common) / F.size(union))


def distinct_shingles(of: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below ``k``."""
    top = F.element_at(of, -1).cast("double") + F.lit(2.0**63)
    estimate = F.lit(float(k - 1)) * F.lit(2.0**64) / top
    return F.when(F.size(of) < k, F.size(of).cast("double")).otherwise(estimate)


def containment(part: Column, whole: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``part`` that ``whole`` has (1 for an empty part)."""
    union = distinct_shingles(merge_sketches(part, whole, k), k)
    share = resemblance(part, whole, k) * union / distinct_shingles(part, k)
    return F.when(F.size(part) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def fingerprint(of: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.concat_ws("", F.transform(of, lambda h: F.lpad(F.hex(h), 16, "0")))


# --- the following document -------------------------------------------------------------------

def _cuts(rows: DataFrame, range_rows: int) -> tuple[list[int], int]:
    """Ids that start a range, from a bounded sample of ids, and the lowest id.

    Where the cuts fall changes the balance of the work only, never a result.
    """
    count, lowest = rows.agg(F.count(F.lit(1)), F.min("key")).first()
    wanted = min(MOST_CUTS, count // range_rows)
    if wanted < 1:
        return [], lowest
    every = max(1, count // (4 * MOST_CUTS))
    ids = sorted(r[0] for r in rows.select("key").where(
        F.pmod(F.xxhash64("key"), F.lit(every)) == 0).distinct().collect())
    step = max(1, len(ids) // wanted)
    return ids[step::step], lowest


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, text`` with ``bucket``, ``ghost`` and ``next_text``; ghosts only serve windows.

    The order is ascending ``doc_id`` (null first), then text; the last row's next is the first.
    """
    rows = docs.withColumn("key", F.coalesce("doc_id", F.lit(_LOWEST)))
    cuts, lowest = _cuts(rows, range_rows)
    bounds = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    at: Column = F.lit(0)
    ranged = rows.withColumn("_at", at)
    for bit in reversed(range(len(cuts).bit_length())):  # bisection
        half = 1 << bit
        above = F.coalesce(F.col("key") >= F.get(bounds, F.col("_at") + half - 1), F.lit(False))
        ranged = ranged.withColumn("_at", F.col("_at") + F.when(above, half).otherwise(0))
    none = F.lit(None).cast("int")
    homes = F.array(
        F.struct(F.col("_at").alias("bucket"), F.lit(False).alias("ghost")),
        F.struct(F.when(F.get(bounds, F.col("_at") - 1) == F.col("key"), F.col("_at") - 1)
                 .otherwise(none).alias("bucket"), F.lit(True).alias("ghost")),
        F.struct(F.when(F.col("key") == F.lit(lowest), F.lit(len(cuts))).otherwise(none)
                 .alias("bucket"), F.lit(True).alias("ghost")))
    placed = ranged.select(
        "doc_id", "key", "text", F.inline(F.filter(homes, lambda h: h["bucket"].isNotNull())))
    return placed.withColumn("next_text", F.lead("text").over(_inside()))


def _inside() -> Window:
    return Window.partitionBy("bucket").orderBy("ghost", "key", "text")


def fingerprint_edits(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles``. The edited text has its last half (rounded down, in code points) replaced by as
    many first code points of the following document. Null text counts as empty; a null id comes
    first; repeated rows follow each other. Ids are expected to be keys: rows of one id stay in one
    range. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, half = F.length("text"), F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    sketched = (
        with_next(rows, range_rows)
        .withColumn("edited", edited)
        .withColumn("own", sketch(F.col("text"), k))
        .select("doc_id", "key", "bucket", "ghost", "text", "edited", "own",
                F.length("text").cast("bigint").alias("n_chars"))
        .withColumn("next_own", F.lead("own").over(_inside()))
        .where(~F.col("ghost"))
        .withColumn("other", sketch(F.col("edited"), k))
    )
    return sketched.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_shingles"),
    )
