"""From raw documents to packed training sequences, one written stage after the other.

Each stage works on all that the one before kept: the quality classifier drops rejected documents,
near-duplicates leave one document per class, mixing takes documents by target weights (each at
most once, so that a document stays one row), and packing lays their tokens into sequences. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm import mixing, near_dedup, packing, quality
from askgrid.llm.queries import MIX_LEVELS, MIX_WEIGHTS, domain_of
from askgrid.plans.shared import written

MIX_SHARE = 0.8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, within one epoch.

    Columns have plain names meanwhile, so that a column of ``docs`` called like one of the tree or
    of the operator (``domain``, ``epoch``) comes back as it was.
    """
    plain = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    tree = docs.select(*[docs[f"`{c}`"].alias(name) for c, name in plain.items()],
                       domain_of(F.col("source")).alias("domain"))
    taken = mixing.mix(
        tree, [plain.get(c, c) if c != "domain" else c for c in MIX_LEVELS], MIX_WEIGHTS, MIX_SHARE,
        max_epochs=1, id_col=plain["doc_id"], text_col=plain["text"])
    return taken.select(*plain.values()).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", classify), ("near_dedup", deduplicate), ("mix", mix), ("pack", pack)]

#: Fitted models, signatures and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
