"""Plans that stay balanced when one key holds a large share of all rows.

* ``number_within``: exact row numbers per key without putting a key into one task;
* ``attach_per_key``: join per-key aggregates back, salting only the keys known to be hot;
* ``exact_percentiles``: interpolated percentiles from pre-aggregated counts.

All are lazy: no action runs and nothing is collected. Range bounds travel as a scalar subquery
of fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 10
SKETCH_GROUPS = 64
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000
SALTS = 32


def with_range(df: DataFrame, value: str, source: DataFrame, measured: Column,
               bits: int = RANGE_BITS) -> DataFrame:
    """Add ``_range``: which of ``2 ** bits`` about equally filled ranges holds ``value``.

    The bounds are quantiles of ``source`` of fixed size, attached as a scalar subquery. They are
    taken in two levels, per group of input partitions and then over the groups' quantiles, so no
    task merges the sketches of all partitions. Bounds decide balance only, never a result.
    The range is found by bisection, one small projection per bit. (Comparing with all bounds in
    one expression makes a method too long for the JIT compiler and is many times slower.)
    """
    total = 2**bits
    cuts = ", ".join(f"{i / total!r}D" for i in range(1, total))
    sketch = F.expr(f"percentile_approx(_m, array({cuts}), {4 * total})")
    groups = source.select(
        measured.alias("_m"), (F.spark_partition_id() % SKETCH_GROUPS).alias("_g")
    ).groupBy("_g").agg(sketch.alias("b"))
    bounds = groups.select(F.explode("b").alias("_m")).agg(sketch.alias("b")).scalar()
    out = (
        df.withColumn("_bounds", bounds)
        .withColumn("_value", F.col(value).cast("double"))
        .withColumn("_at0", F.lit(0))
    )
    for bit in range(bits):
        half = 2 ** (bits - bit - 1)
        above = f"coalesce(_value > get(_bounds, _at{bit} + {half - 1}), false)"
        out = out.withColumn(f"_at{bit + 1}", F.expr(f"_at{bit} + if({above}, {half}, 0)"))
    return out.select(*df.columns, F.col(f"_at{bits}").alias("_range"))


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    tie: Sequence[str] = (),
    bits: int = RANGE_BITS,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Add ``name``: 1, 2, ... per ``keys`` by ``order`` (numeric or timestamp), then ``tie``.

    Rows are cut into ``2 ** bits`` global ranges of ``order`` holding about equal row counts, so
    no (key, range) group exceeds about that share of the table even if one key owns everything.
    Counts per (key, range) are pre-aggregated; their running sum is the offset of each range.
    The columns of ``per_key`` (at most one row per key) come along with the offsets, which spares
    a join of their own.
    """
    ranged = with_range(df, order, df, F.col(order).cast("double"), bits)
    group = [*keys, "_range"]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if per_key is not None:
        offsets = offsets.join(per_key, list(keys), "left")
    inside = Window.partitionBy(*group).orderBy(order, *tie)
    return (
        ranged.join(offsets, group, "left")
        .withColumn(name, (F.row_number().over(inside) + F.col("_offset")).cast("bigint"))
        .drop("_range", "_offset")
    )


def attach_per_key(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    row_count: str,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    how: str = "left",
) -> DataFrame:
    """Join ``per_key`` (one row per key, with its number of ``df`` rows) back to ``df``.

    The keys above ``hot_rows``, at most the ``HOT_KEYS`` largest, are spread over ``salts``
    tasks; the rest join plainly. That list has a fixed size limit, which is what makes its
    broadcast safe. ``row_count`` is dropped from the result.
    """
    keys = list(keys)
    hot = F.broadcast(
        per_key.where(F.col(row_count) > hot_rows)
        .orderBy(F.col(row_count).desc(), *keys)
        .limit(HOT_KEYS)
        .select(*keys, F.lit(salts).cast("bigint").alias("_salts"))
    )
    spread = (
        df.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.when(
                F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*df.columns), F.col("_salts"))
            ).otherwise(F.lit(0).cast("bigint")),
        )
        .drop("_salts")
    )
    last = F.coalesce(F.col("_salts"), F.lit(1).cast("bigint")) - 1
    replicated = (
        per_key.drop(row_count)
        .join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .drop("_salts")
    )
    return spread.join(replicated, [*keys, "_salt"], how).drop("_salt")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    names: Sequence[str],
    bits: int = RANGE_BITS,
) -> DataFrame:
    """Linear-interpolated percentiles per ``keys``, position ``(n - 1) * fraction``.

    Equal values are counted before any shuffle. Only the value ranges that contain a wanted
    position are sorted, so no task sorts a whole group.
    """
    keys = list(keys) or ["_all"]
    rows = df.where(F.col(value).isNotNull())
    if keys == ["_all"]:
        rows = rows.withColumn("_all", F.lit(0))
    measured = F.col(value).cast("double")
    counted = with_range(
        rows.groupBy(*keys, measured.alias("_v")).agg(F.count(F.lit(1)).alias("_c")),
        "_v", rows, measured, bits,
    )
    by_key = Window.partitionBy(*keys)
    running = by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[F.lit(float(f)) for f in fractions])
    ranged = (
        counted.groupBy(*keys, "_range")
        .agg(F.sum("_c").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(by_key))
        .withColumn("_places", F.transform(wanted, lambda f: (F.col("_total") - 1) * f))
        .where(
            F.exists(
                F.flatten(F.transform("_places", lambda p: F.array(F.floor(p), F.ceil(p)))),
                lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")),
            )
        )
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_v")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        counted.join(ranged, [*keys, "_range"])
        .withColumn("_end", F.col("_before") + F.sum("_c").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    result = []
    for position, name in enumerate(names):
        place = F.element_at("_places", position + 1)

        def at(spot: Column) -> Column:
            return F.max(
                F.when((spot >= F.col("_start")) & (spot < F.col("_end")), F.col("_v"))
            )

        low, high = at(F.floor(place)), at(F.ceil(place))
        weight = F.max(place - F.floor(place))
        result.append((low * (1 - weight) + high * weight).alias(name))
    out = hits.groupBy(*keys).agg(*result)
    return out.drop("_all") if keys == ["_all"] else out
