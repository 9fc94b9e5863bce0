"""Quality classifier with hierarchical empirical Bayes over sites.

A document gives evidence: the probability of being good by a logistic model on cheap shape
features, fitted on a bounded sample of labelled rows. A site (host, then path inside the host)
has a posterior share of good documents, shrunk towards the level above in proportion to how few
documents it has and to how alike sites are: the prior's strength is estimated from all sites by
moments. The verdict adds the site's log-odds shift to the document's own log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.llm.encoding import slices, tidy
from askgrid.plans.shared import written

#: The most labelled rows the model is fitted on.
FIT_ROWS = 20_000
RIDGE = 1e-2
THRESHOLD = 0.5
MOST_STRENGTH = 1e6
LEVELS = ("source", "lang")
FEATURES = 14
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~_=+<>{}[]\\", "!?", "|/", ".,;:",
            "\n", " \t")


def features(texts: pa.Array) -> np.ndarray:
    """One row of shape features per text: shares of byte classes, word lengths and repeats."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    low, high = int(bounds[0]), int(bounds[-1])
    raw = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.empty(0, np.uint8)
    bounds = bounds - low
    size = np.maximum(np.diff(bounds), 1)
    out = np.zeros((len(texts), FEATURES))
    for i, members in enumerate(_CLASSES):
        table = np.zeros(256, bool)
        table[list(members.encode())] = True
        held = np.concatenate([[0], np.cumsum(table[raw])])
        out[:, i] = (held[bounds[1:]] - held[bounds[:-1]]) / size
    split = pc.utf8_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)[codes] \
        if codes.size else codes
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    words = np.maximum(n, 1)
    width = max(len(coded.dictionary), 1)
    packed = owner * width + codes
    again = np.zeros(packed.size, bool)
    again[1:] = packed[1:] == packed[:-1]
    packed.sort()
    fresh = np.ones(packed.size, bool)
    fresh[1:] = packed[1:] != packed[:-1]
    distinct = np.bincount(packed[fresh] // width, minlength=len(texts))
    mean = np.bincount(owner, lengths, len(texts)) / words
    square = np.bincount(owner, lengths.astype(float) ** 2, len(texts)) / words
    out[:, 8] = np.log1p(n)
    out[:, 9] = distinct / words
    out[:, 10] = np.log1p(distinct) / np.log1p(words)
    out[:, 11] = np.bincount(owner, again, len(texts)) / words
    out[:, 12] = mean
    out[:, 13] = np.sqrt(np.maximum(square - mean**2, 0))
    return out


@dataclass(frozen=True)
class Model:
    """Weights on standardised features and their squares; ``weights[0]`` is the offset."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        return np.hstack([np.ones((len(x), 1)), z, z**2])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -12, 12)


def fit(x: np.ndarray, good: np.ndarray) -> Model:
    """Ridge logistic regression by Newton steps; with one class only, the offset alone."""
    centre = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    spread = x.std(axis=0) if len(x) else np.ones(FEATURES)
    model = Model(centre, np.where(spread > 1e-9, spread, 1.0), np.zeros(2 * FEATURES + 1))
    if not len(x) or good.min() == good.max():
        return model
    design, weights = model._design(x), model.weights.copy()
    penalty = np.full(weights.size, RIDGE * len(x) / 100)
    penalty[0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (good - p) - penalty * weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        weights = weights + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Model(model.centre, model.spread, weights)


# --- the jobs -----------------------------------------------------------------------------------

_EVIDENCE = "_quality_evidence"


@tidy
def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, size in slices(batch.column(0)):
            x = features(batch.column(0).slice(first, size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(first, size), batch.column(2).slice(first, size),
                 pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(
                     pa.list_(pa.float64()))], names=["_id", "good", "x"])


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the ``fit_rows`` labelled documents whose ids hash lowest.

    Labels of one id are averaged; null ids and null labels are left out. Of rows that share an id,
    the one with the smallest features counts. Without labels, or with
    labels of one class only, every document gets even evidence.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("bigint").alias("_id"))
        .agg((F.avg(F.col(label_col).cast("double")) > 0.5).cast("double").alias("good"))
        .orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "_id").select("text", "_id", "good")
    got = rows.mapInArrow(_with_features, "_id bigint, good double, x array<double>").groupBy(
        "_id").agg(F.min("x").alias("x"), F.first("good").alias("good")).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, FEATURES)
    order = np.lexsort(x.T[::-1])  # the same sums whatever order tasks end in
    return fit(x[order], got["good"].to_numpy(float)[order])


def _score(model: Model, place: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size in slices(batch.column(place)):
                part = batch.slice(first, size)
                odds = model.log_odds(features(part.column(place)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(odds)], names=[*part.schema.names, _EVIDENCE])

    return run


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the log-odds of being good in a last column."""
    schema = T.StructType([*docs.schema.fields, T.StructField(_EVIDENCE, T.DoubleType())])
    return docs.mapInArrow(_score(model, docs.columns.index(text_col)), schema)


def _share(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _odds(share: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), share))
    return F.log(held / (1 - held))


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength in documents: alike groups give a strong prior, unlike ones a weak one.

    Moments: the spread of group means beyond what groups of their sizes show by chance.
    """
    n, share = F.col("n"), F.col("s") / F.col("n")
    row = groups.agg(
        F.sum(n * (share - F.col(mean)) ** 2).alias("between"),
        F.sum(F.col("q") - F.col("s") ** 2 / n).alias("inside"),
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(n**2).alias("n2"),
        F.sum(n * F.col(mean) * (1 - F.col(mean))).alias("spread")).first()
    if not row["n"] or row["n"] <= row["groups"] or row["groups"] < 2:
        return MOST_STRENGTH
    chance = row["inside"] / (row["n"] - row["groups"])
    size = row["n"] - row["n2"] / row["n"]
    between = (row["between"] - (row["groups"] - 1) * chance) / size if size > 0 else 0.0
    if between <= 0:
        return MOST_STRENGTH
    return float(min(MOST_STRENGTH, max(1.0, row["spread"] / row["n"] / between - 1)))


def site_posteriors(evidence: DataFrame, levels: Sequence[str]) -> tuple[DataFrame, float]:
    """``levels..., _posterior`` of every path, and the global share of good documents.

    ``evidence`` has the level columns and the log-odds. Sums are taken per path first, so a site
    with most of the documents is one row before anything else happens.
    """
    levels = list(levels)
    share = _share(F.col(_EVIDENCE))
    paths = evidence.groupBy(*levels).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(share).alias("s"),
        F.sum(share**2).alias("q"))
    paths = written(paths)
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    top = float(total[0] / total[1]) if total[1] else 0.5
    above = None
    for depth in range(1, len(levels) + 1):
        keys = levels[:depth]
        groups = paths.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
        if above is None:
            groups = groups.withColumn("_prior", F.lit(top))
        else:
            match = [F.col(f"g.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys[:-1]]
            groups = groups.alias("g").join(above.alias("a"), match, "left").select(
                "g.*", F.col("a._posterior").alias("_prior"))
        strength = _strength(groups, "_prior")
        above = groups.select(*keys, (
            (F.lit(strength) * F.col("_prior") + F.col("s")) / (F.lit(strength) + F.col("n"))
        ).alias("_posterior"))
    return written(above), top


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
            levels: Sequence[str], fit_rows: int) -> DataFrame:
    model = fit_model(docs, labels, id_col, text_col, label_col, fit_rows)
    scored = with_evidence(docs, model, text_col)
    narrow = with_evidence(docs.select(text_col, *levels), model, text_col)
    sites, top = site_posteriors(narrow.select(*levels, _EVIDENCE), levels)
    # Sites are a written table: if it is small it goes to every task, else the join is a shuffle
    # in which adaptive execution splits a hot site.
    renamed = sites.select(*[F.col(c).alias(f"_site_{i}") for i, c in enumerate(levels)],
                           F.col("_posterior").alias("_site_posterior"))
    match = [scored[c].eqNullSafe(renamed[f"_site_{i}"]) for i, c in enumerate(levels)]
    joined = scored.join(renamed, match, "left").drop(*[f"_site_{i}" for i in range(len(levels))])
    shift = _odds(F.coalesce("_site_posterior", F.lit(top))) - _odds(F.lit(top))
    return joined.withColumn("_quality", _share(F.col(_EVIDENCE) + shift))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    levels: Sequence[str] = LEVELS,
    fit_rows: int = FIT_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, evidence, site_posterior, quality, keep`` of every row.

    ``levels`` are columns from host to path. A null level is a site of its own; null text counts
    as empty; a null id is kept; repeated rows are judged each. An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                         F.col(text_col).alias("text"), *levels)
    judged = _judged(narrow, labels.select(F.col(id_col).alias("doc_id"), label_col), "doc_id",
                     "text", label_col, levels, fit_rows)
    return judged.select(
        "doc_id", _share(F.col(_EVIDENCE)).alias("evidence"),
        F.col("_site_posterior").alias("site_posterior"), F.col("_quality").alias("quality"),
        (F.col("_quality") >= threshold).alias("keep"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    levels: Sequence[str] = LEVELS,
    fit_rows: int = FIT_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that are judged good, with their own columns only."""
    return _judged(docs, labels, id_col, text_col, label_col, levels, fit_rows).where(
        F.col("_quality") >= threshold).select(*docs.columns)
