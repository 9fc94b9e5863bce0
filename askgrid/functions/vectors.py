"""Vector column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: relative and absolute tolerance on the L2 norm of a normalized vector.
NORM_TOLERANCE = 1e-3


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(as_double(vector), F.lit(0.0), lambda acc, x: acc + x * x)
    )


def vector_violation(vector: Column, dimension: int, normalized: bool = True) -> Column:
    """Code of the first rule a vector breaks, else null."""
    norm = l2_norm(vector)
    not_finite = F.exists(
        as_double(vector),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    code = (
        F.when(vector.isNull(), "missing_vector")
        .when(F.size(vector) != dimension, "dimension_mismatch")
        .when(not_finite, "not_finite")
        .when(norm == 0, "zero_norm")
    )
    if normalized:
        bound = NORM_TOLERANCE * F.greatest(norm, F.lit(1.0))
        code = code.when(F.abs(norm - 1.0) > F.greatest(bound, F.lit(NORM_TOLERANCE)), "not_normalized")
    return code


def hash_vector(text: Column, dimension: int, normalized: bool = True) -> Column:
    """Deterministic stand-in embedding: the bytes of SHA-256 of the text, mapped to [-1, 1].

    Byte ``i mod 32`` gives component ``i`` as ``(byte - 127.5) / 127.5``; the result is scaled
    to unit length when ``normalized``.
    """
    from askgrid.functions.lets import let

    def components(digest: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dimension - 1)),
            lambda i: (
                F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
                - 127.5
            )
            / 127.5,
        )

    raw = let(F.sha2(text, 256), components)
    if not normalized:
        return raw
    return let(raw, lambda v: let(l2_norm(v), lambda n: F.transform(v, lambda x: x / n)))
