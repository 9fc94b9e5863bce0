"""Mixing sources to target weights by hierarchical budgets.

Leaves are paths of a tree (domain, language, source). A node's capacity is the sum of its leaves',
a leaf's is its tokens times the epochs it may be repeated. From the root down, a node shares its
budget among its children in proportion to their weights; what a child cannot take goes to its
siblings by weight, until all are served or full. Leaves with a node of weight 0 on their path take
nothing and count for no capacity. As no node is given more than it can hold, shortages are settled
among siblings before anything returns to an ancestor, and up to rounding the whole budget is dealt
where the leaves can hold it. All amounts are whole tokens in integer arithmetic.

A leaf takes whole epochs and a token-prefix of one more. An epoch's order is a seeded hash of the
ids, so the prefix is a threshold on that hash. It is found without sorting a leaf in one place:
hash ranges are summed first, and only the one range that holds the cut is looked into.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.plans.shared import written

SEED = 17
MAX_EPOCHS = 2
BUDGET_SHARE = 0.8
#: Hash ranges per leaf: as many as three hexadecimal digits tell apart.
RANGE_DIGITS = 3
_BIG = "decimal(38,0)"


def count_words(text: Column) -> Column:
    """White-space separated words; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"),
                           lambda w: w != "")).cast("bigint")


def order_key(id_col: Column, epoch: Column, seed: int) -> Column:
    """Position of a document within an epoch, as hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(id_col.cast("string"), F.lit("null"))))


def _share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``allocated`` to children with ``capacity``, ``weight`` and their parent's ``budget``.

    Sorted by how soon they are full, the children that end up full are a prefix; the rest share
    what is left by weight, rounded down.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # Weightless children come last and get nothing.
    fullness = F.when(F.col("weight") > 0,
                      F.col("capacity").cast("double") / F.col("weight").cast("double"))
    ordered = by.orderBy(fullness.asc_nulls_last(), F.col(name).asc_nulls_first())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("budget") - F.col("_before")
    return (
        children
        .withColumn("_before", F.coalesce(F.sum("capacity").over(before), F.lit(0).cast(_BIG)))
        .withColumn("_weights", F.sum("weight").over(after))
        .withColumn("_full", (F.col("weight") > 0) & (
            F.col("capacity").cast(_BIG) * F.col("_weights") <= F.col("weight") * left))
        .withColumn("_place", F.row_number().over(ordered))
        .withColumn("_first", F.min(F.when(~F.col("_full"), F.struct(
            "_place", left.alias("left"), F.col("_weights").alias("weights")))).over(by))
        .withColumn("allocated", F.when(F.col("_full"), F.col("capacity")).when(
            F.col("weight") > 0, F.least(F.col("capacity"), F.expr(
                "cast(weight * _first.left as decimal(38,0)) div _first.weights")))
            .otherwise(F.lit(0)).cast("bigint"))
        .drop("_before", "_weights", "_full", "_place", "_first")
    )


def allocate(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int],
             budget: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``levels..., tokens, allocated`` for every leaf (``levels..., tokens``).

    All leaves count for the capacity of their nodes: see ``allocate_all`` for weights of 0.
    ``weights`` maps paths (tuples from the root) to whole numbers of at least 0; a node that is not
    named has weight 1. It is a parameter, small by nature.
    """
    levels = list(levels)
    spark = leaves.sparkSession
    given = None
    for depth in range(1, len(levels) + 1):
        keys = levels[:depth]
        nodes = leaves.groupBy(*keys).agg(
            (F.sum("tokens") * max_epochs).cast(_BIG).alias("capacity"))
        named = [(*path, int(w)) for path, w in weights.items() if len(path) == depth]
        table = spark.createDataFrame(
            named, ", ".join([*[f"_k{i} string" for i in range(depth)], "_w bigint"]))
        match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        nodes = nodes.join(F.broadcast(table), match, "left").select(
            *keys, "capacity", F.coalesce("_w", F.lit(1)).cast(_BIG).alias("weight"))
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast(_BIG))
        else:
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys[:-1]]
            nodes = nodes.alias("n").join(given.alias("g"), same).select(
                "n.*", F.col("g.allocated").cast(_BIG).alias("budget"))
        given = _share_out(nodes, keys[:-1], keys[-1]).select(*keys, "allocated")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"g.{k}")) for k in levels]
    return leaves.alias("l").join(given.alias("g"), same).select("l.*", "g.allocated")


def allocate_all(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int],
                 budget: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``allocate`` among the leaves whose whole path has a positive weight; 0 for the others.

    The amounts sum up to the budget or to what these leaves can hold, whichever is less, but for
    less than one token for each child of a node by rounding down.
    """
    levels, spark, able = list(levels), leaves.sparkSession, leaves
    for depth in range(1, len(levels) + 1):
        closed = [tuple(path) for path, w in weights.items()
                  if len(path) == depth and int(w) == 0]
        table = spark.createDataFrame(closed, ", ".join(f"_k{i} string" for i in range(depth)))
        match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(levels[:depth])]
        able = able.join(F.broadcast(table), match, "left_anti")
    given = allocate(able, levels, weights, budget, max_epochs).select(
        *[F.col(k).alias(f"_{k}") for k in levels], F.col("allocated").alias("_allocated"))
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in levels]
    return leaves.join(given, match, "left").select(
        *leaves.columns, F.coalesce("_allocated", F.lit(0).cast("bigint")).alias("allocated"))


def leaf_cuts(documents: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int],
              budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    """``levels..., tokens, allocated, epochs, cut``: how much of each leaf is taken.

    ``documents`` has ``doc_id``, the levels and ``tokens``. ``epochs`` whole epochs are taken, and
    of the next one the documents whose key is at most ``cut`` (none if null): the longest prefix
    whose tokens fit what is left. Documents with one id stand at one place of the order.
    """
    levels = list(levels)
    leaves = written(documents.groupBy(*levels).agg(F.sum("tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    shares = allocate_all(leaves, levels, weights, int(total * budget_share), max_epochs)
    taken = written(shares.select(
        *levels, "tokens", "allocated",
        F.expr("if(tokens > 0, allocated div tokens, 0)").alias("epochs"),
        F.expr("if(tokens > 0, allocated % tokens, 0)").alias("rest")))
    partial = taken.where("rest > 0").select(
        *[F.col(c).alias(f"_{c}") for c in levels], "epochs", "rest")
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels]
    keyed = documents.join(partial, match).withColumn(
        "key", order_key(F.col("doc_id"), F.col("epochs"), seed)).select(
        *levels, "tokens", "rest", "key", F.substring("key", 1, RANGE_DIGITS).alias("range"))
    upto = Window.partitionBy(*levels).orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    ranges = (
        keyed.groupBy(*levels, "range").agg(
            F.sum("tokens").alias("n"), F.max("key").alias("last"), F.first("rest").alias("rest"))
        .withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    )
    whole = ranges.where("before + n <= rest").select(*levels, F.col("last").alias("key"))
    split = ranges.where("before <= rest and before + n > rest").select(
        *[F.col(c).alias(f"_{c}") for c in levels], F.col("range").alias("_range"), "before")
    inside = Window.partitionBy(*levels, "range").orderBy("key").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    edge = keyed.join(split, [*match, F.col("range") == F.col("_range")]).withColumn(
        "upto", F.sum("tokens").over(inside) + F.col("before")).where("upto <= rest").select(
        *levels, "key")
    cuts = whole.unionByName(edge).groupBy(*levels).agg(F.max("key").alias("cut"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in levels]
    return written(taken.alias("t").join(cuts.alias("c"), same, "left").select(
        *[f"t.{c}" for c in levels], "t.tokens", "t.allocated", "t.epochs", "c.cut"))


def mix(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Mapping[tuple, int],
    budget_share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    tokens: Column | None = None,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with a last column ``epoch``: one row for each time a document is taken.

    The budget is ``budget_share`` of all tokens (words of ``text_col`` unless ``tokens`` is given;
    null tokens count as 0). A null level is a node of its own; null ids stand at one place of the
    order; repeated rows are taken together. A leaf without tokens is left out. ``levels`` must not
    be named ``doc_id``, ``tokens`` or ``epoch``. An empty table gives no rows.
    """
    levels = list(levels)
    amount = F.coalesce(count_words(F.col(text_col)) if tokens is None else tokens, F.lit(0))
    narrow = written(docs.select(F.col(id_col).alias("doc_id"), *levels,
                                 amount.cast("bigint").alias("tokens")))
    # One small row per leaf: a written table, whose true size decides how it is joined.
    cuts = leaf_cuts(narrow, levels, weights, budget_share, max_epochs, seed)
    leaf = cuts.select(*[F.col(c).alias(f"_leaf_{i}") for i, c in enumerate(levels)],
                       F.col("epochs").alias("_epochs"), F.col("cut").alias("_cut"))
    match = [docs[c].eqNullSafe(leaf[f"_leaf_{i}"]) for i, c in enumerate(levels)]
    in_part = F.coalesce(
        order_key(F.col(id_col), F.col("_epochs"), seed) <= F.col("_cut"), F.lit(False))
    times = F.col("_epochs") + F.when(in_part, 1).otherwise(0)
    return (
        docs.join(leaf, match)
        .withColumn("_times", times)
        .where("_times > 0")
        .select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col("_times").cast("int") - 1))
                .alias("epoch"))
    )
