"""Bind a column to a name inside an expression, so it is evaluated once per row.

Catalyst may inline a projected column into the lambda that uses it, and then evaluate it once
per array element. Binding through a one-element array keeps the cost linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indexed(values: Column) -> Column:
    """``array<T>`` to ``array<struct<i: 0-based index, v: T>>``."""
    return F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v")))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` plus ``columns``, evaluated once however often later steps filter or read them.

    A filter on a plain projected column is pushed below it together with a copy of its
    expression. A generator stops that, at the cost of a one-element array per row.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*df.columns, F.explode(packed).alias("_once")).select(
        *kept, *[F.col(f"_once.{n}").alias(n) for n in columns]
    )
