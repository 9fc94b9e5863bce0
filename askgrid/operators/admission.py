"""Document admission: size, type agreement, signature, encoding and control characters.

All checks are one chain of column expressions; the first failing rule names the reject code.
A rejected document becomes a row of the reject table instead of stopping the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.lets import computed_once
from askgrid.functions.text import DISALLOWED_CONTROL, strip

MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_CHARS = 5_000_000
# File extensions, media types and their formats.
EXTENSIONS = {
    ".csv": "csv",
    ".docx": "docx",
    ".md": "markdown",
    ".markdown": "markdown",
    ".pdf": "pdf",
    ".txt": "plain_text",
}
MEDIA_TYPES = {
    "application/csv": "csv",
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/csv": "csv",
    "text/markdown": "markdown",
    "text/x-markdown": "markdown",
    "text/plain": "plain_text",
}
CANONICAL_TYPES = {
    "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "markdown": "text/markdown",
    "pdf": "application/pdf",
    "plain_text": "text/plain",
}
GENERIC_TYPES = ("application/octet-stream", "binary/octet-stream")
BINARY_FORMATS = ("docx", "pdf")


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small fixed table, null if absent."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def basename(filename: Column) -> Column:
    """Last path component, with either slash."""
    return F.regexp_extract(F.replace(strip(filename), F.lit("\\"), F.lit("/")), r"[^/]*$", 0)


def extension(filename: Column) -> Column:
    """Lower-case extension with its dot, or empty; a leading dot is not an extension."""
    return F.lower(F.regexp_extract(basename(filename), r"(?s)^.+(\.[^.]+)$", 1))


def base_media_type(media_type: Column) -> Column:
    """Media type without parameters, lower-case; null when empty."""
    return F.nullif(strip(F.lower(F.split(media_type, ";")[0])), F.lit(""))


def format_code(suffix: Column, declared: Column) -> tuple[Column, Column]:
    """``(format, reject code)`` from ``extension`` and ``base_media_type``.

    A known extension decides; an unknown one is rejected whatever the media type says. A
    generic media type never conflicts, any other must agree with the extension.
    """
    by_suffix, by_type = _lookup(EXTENSIONS, suffix), _lookup(MEDIA_TYPES, declared)
    code = (
        F.when((suffix != "") & by_suffix.isNull(), "unsupported_type")
        .when(
            by_suffix.isNotNull() & declared.isNotNull()
            & ~declared.isin(*GENERIC_TYPES) & by_type.isNull(),
            "type_mismatch",
        )
        .when(by_suffix.isNotNull() & by_type.isNotNull() & (by_suffix != by_type),
              "type_mismatch")
        .when(F.coalesce(by_suffix, by_type).isNull(), "unsupported_type")
    )
    return F.coalesce(by_suffix, by_type), code


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes without byte-order mark and with line feeds only."""
    text = F.regexp_replace(content.cast("string"), "^\ufeff", "")
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def identify(df: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_chars: int = MAX_CHARS
             ) -> DataFrame:
    """Add ``document_format, canonical_type, byte_size, content_sha256, text, reject_code``.

    Input: ``filename, media_type, content`` (binary) and any key columns. Checks run in the
    order size, type, signature or zero byte, encoding, length, control characters. The text is
    null for binary formats.
    """
    content = F.col("content")
    typed = computed_once(df, {
        "byte_size": F.octet_length(content),
        "content_sha256": F.sha2(content, 256),
        "_suffix": extension(F.col("filename")),
        "_declared": base_media_type(F.col("media_type")),
    })
    fmt, type_code = format_code(F.col("_suffix"), F.col("_declared"))
    sized = computed_once(typed, {"document_format": fmt, "_type_code": type_code}).drop(
        "_suffix", "_declared")
    binary = F.col("document_format").isin(*BINARY_FORMATS)
    signed = F.when(
        F.col("document_format") == "pdf",
        F.startswith(content, F.unhex(F.lit("255044462D"))),
    ).otherwise(F.contains(content, F.unhex(F.lit("504B0506"))))
    early = (
        F.when(F.coalesce(F.col("byte_size"), F.lit(0)) == 0, "empty_file")
        .when(F.col("byte_size") > max_bytes, "file_too_large")
        .when(F.col("_type_code").isNotNull(), F.col("_type_code"))
        .when(binary & ~signed, "invalid_file_signature")
        .when(binary, F.lit(None))
        .when(F.contains(content, F.unhex(F.lit("00"))), "binary_content")
        .when(~F.is_valid_utf8(content.cast("string")), "invalid_encoding")
    )
    opened = computed_once(sized, {"_early": early})
    readable = F.col("_early").isNull() & ~binary
    decoded_once = computed_once(opened, {"text": F.when(readable, decoded(content))})
    code = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.length("text") > max_chars, "resource_limit_exceeded")
        .when(F.col("text").rlike(DISALLOWED_CONTROL), "binary_content")
    )
    return (
        computed_once(decoded_once, {"reject_code": code})
        .withColumn("canonical_type", _lookup(CANONICAL_TYPES, F.col("document_format")))
        .withColumn("text", F.when(F.col("reject_code").isNull(), F.col("text")))
        .drop("_type_code", "_early")
    )


def admit_documents(df: DataFrame, strict: bool = False, **limits: int
                    ) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejects)``; with ``strict`` the job fails on the first reject instead."""
    checked = identify(df, **limits)
    if strict:
        failed = F.raise_error(F.concat(F.lit("document rejected: "), F.col("reject_code")))
        checked = checked.withColumn(
            "reject_code", F.when(F.col("reject_code").isNotNull(), failed))
    accepted = checked.where(F.col("reject_code").isNull()).drop("reject_code")
    rejects = checked.where(F.col("reject_code").isNotNull()).drop("content", "text")
    return accepted, rejects


def reject_empty(documents: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Accepted documents that gave no block, with code ``empty_content``."""
    return documents.select(key).join(
        blocks.select(key).distinct(), key, "left_anti"
    ).withColumn("reject_code", F.lit("empty_content"))
