"""Corpus folders and evaluation sets as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the key line in a document's front matter.
DOC_ID_LINE = r"(?m)^doc_id:\s*([A-Z][A-Z0-9_]+)\s*$"
# The columns of an evaluation set.
EVAL_SCHEMA = (
    "query_id string, query string, intent_l1 string, intent_l2 string, difficulty string, "
    "requires_rag boolean, requires_tool boolean, expected_answer_type string, "
    "expected_doc_ids array<string>, expected_doc_ids_nice array<string>, trap_type string, "
    "ground_truth string, eval_metrics array<string>"
)


def scan_corpus(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """Files below ``root``: ``category`` (first folder), ``relative_path, filename, content``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return corpus_files(files, root)


def corpus_files(files: DataFrame, root: str) -> DataFrame:
    """``category, relative_path, filename, content_sha256, content`` from ``path, content``.

    A path is read relative to the first place where the root's last two parts stand in it, so a
    folder below that is named like the root does not matter.
    """
    base = "/".join(root.rstrip("/").split("/")[-2:])
    relative = F.regexp_extract("path", f"^.*?{_quote(base)}/(.*)$", 1)
    return files.select(
        F.when(F.contains(relative, F.lit("/")), F.split(relative, "/")[0]).alias("category"),
        relative.alias("relative_path"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.sha2("content", 256).alias("content_sha256"),
        "content",
    )


def corpus_documents(files: DataFrame, categories: Sequence[str],
                     special: Mapping[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """``(documents, problems)``: files of the named categories and the special files.

    ``special`` maps a relative path to its fixed document id and category; other documents take
    their id from the front matter, so theirs is null here. A category without files and a special
    file that is absent are problems (``code, name``).
    """
    spark = files.sparkSession
    fixed = spark.createDataFrame([(p, *v) for p, v in special.items()],
                                  "relative_path string, _id string, _category string")
    marked = files.join(F.broadcast(fixed), "relative_path", "left").where(
        F.col("_id").isNotNull() | F.col("category").isin(list(categories)))
    documents = marked.select(
        F.col("_id").alias("document_id"), F.coalesce("_category", "category").alias("category"),
        "relative_path", "filename", "content_sha256", "content")
    wanted = spark.createDataFrame([(c,) for c in categories], "name string")
    problems = wanted.join(files.select(F.col("category").alias("name")).distinct(), "name",
                           "left_anti").select(F.lit("category_missing").alias("code"), "name")
    absent = fixed.select(F.col("relative_path").alias("name")).join(
        files.select(F.col("relative_path").alias("name")), "name", "left_anti")
    return documents, problems.unionByName(
        absent.select(F.lit("special_missing").alias("code"), "name"))


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_-" else "\\" + c for c in text)


def extract_front_matter_id(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(with doc_key, rejects)``: exactly one key line is required."""
    found = df.withColumn(
        "_ids", F.regexp_extract_all(F.col(text), F.lit(DOC_ID_LINE), F.lit(1))
    )
    good = found.where(F.size("_ids") == 1).withColumn("doc_key", F.col("_ids")[0]).drop("_ids")
    bad = found.where(F.coalesce(F.size("_ids"), F.lit(-1)) != 1).withColumn(
        "reject_code",
        F.when(F.col(text).isNull(), "invalid_encoding")
        .when(F.size("_ids") == 0, "doc_id_missing")
        .otherwise("doc_id_repeated"),
    ).drop("_ids", text)
    return good, bad


def read_eval_set(spark: SparkSession, path: str, schema: str = EVAL_SCHEMA
                  ) -> tuple[DataFrame, DataFrame]:
    """``(samples, rejects)`` from JSON lines; blank and malformed lines become rejects."""
    return parse_eval_lines(spark.read.text(path).select(F.col("value").alias("line")), schema)


def parse_eval_lines(lines: DataFrame, schema: str = EVAL_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """``(samples, rejects)`` of a table of ``line``."""
    lines = lines.select(
        "line",
        F.from_json("line", f"{schema}, _corrupt string",
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("s"),
    )
    bad = (
        F.col("s").isNull() | F.col("s._corrupt").isNotNull() | F.col("s.query_id").isNull()
    )
    samples = lines.where(~bad).select("s.*").drop("_corrupt")
    samples = samples.fillna(False, ["requires_tool"]).withColumn(
        "expected_doc_ids_nice",
        F.coalesce("expected_doc_ids_nice", F.array().cast("array<string>")),
    )
    rejects = lines.where(bad).select(
        "line",
        F.when(F.length(F.trim("line")) == 0, "blank_line").otherwise("malformed_line").alias(
            "reject_code"),
    )
    return samples, rejects
