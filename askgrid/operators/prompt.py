"""Citations and prompt text per request, and the model inputs of the other stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.functions.text import escape_markup, ordered_text, strip
from askgrid.operators.fusion import CONTEXT_TOP_K

# Fixed value: what the prompts show in place of a missing part.
NONE_TEXT = "无"


def select_context(ranked: DataFrame, top_k: int = CONTEXT_TOP_K) -> DataFrame:
    """Top-k of each request, numbered 1..n as ``citation_number``."""
    order = Window.partitionBy("request_id").orderBy("rank")
    return ranked.withColumn("citation_number", F.row_number().over(order)).where(
        F.col("citation_number") <= top_k
    )


def source_block(context_columns: list[str]) -> Column:
    """One ``<source ...>`` element; section and page appear only where present."""

    def attribute(name: str, column: str) -> Column:
        return F.concat(F.lit(f' {name}="'), escape_markup(F.col(column).cast("string")),
                        F.lit('"'))

    parts = [
        F.lit("<source"),
        F.concat(F.lit(' id="'), F.col("citation_number").cast("string"), F.lit('"')),
        attribute("document", "display_name"),
        attribute("source_key", "source_key"),
    ]
    for name, column in (("section", "section"), ("page", "page_number")):
        if column in context_columns:
            parts.append(F.coalesce(attribute(name, column), F.lit("")))
    parts += [F.lit(">\n"), escape_markup(F.col("content")), F.lit("\n</source>")]
    return F.concat(*parts)


def memory_block(summary: Column, messages: Column) -> Column:
    """``<conversation_memory>`` for ``array<struct<ordinal, role, content>>``, or empty text."""
    lines = F.transform(
        F.coalesce(messages, F.array().cast("array<struct<ordinal:bigint,role:string,content:string>>")),
        lambda m: F.concat(
            F.lit('<message role="'), m["role"], F.lit('">'), escape_markup(m["content"]),
            F.lit("</message>"),
        ),
    )
    head = F.when(
        summary.isNotNull(),
        F.array(F.lit("<summary>"), escape_markup(summary), F.lit("</summary>")),
    ).otherwise(F.array().cast("array<string>"))
    body = F.array_join(
        F.concat(F.array(F.lit("<conversation_memory>")), head, lines,
                 F.array(F.lit("</conversation_memory>"))),
        "\n",
    )
    empty = summary.isNull() & (F.size(lines) == 0)
    return F.when(empty, F.lit("")).otherwise(F.concat(body, F.lit("\n")))


def build_prompts(context: DataFrame, requests: DataFrame,
                  memory: DataFrame | None = None) -> DataFrame:
    """``(request_id, user_prompt, n_sources)`` for requests with at least one source.

    ``memory``: ``request_id, summary, messages``. A request has at most ``top_k`` sources, so
    the collected list is small.
    """
    blocks = context.withColumn("_block", source_block(context.columns))
    joined = blocks.groupBy("request_id").agg(
        ordered_text(
            F.collect_list(F.struct("citation_number", F.col("_block").alias("text"))), "\n"
        ).alias("_context"),
        F.count(F.lit(1)).alias("n_sources"),
    )
    out = requests.select("request_id", "question").join(joined, "request_id")
    if memory is not None:
        out = out.join(memory, "request_id", "left")
        remembered = memory_block(F.col("summary"), F.col("messages"))
    else:
        remembered = F.lit("")
    return out.select(
        "request_id",
        F.concat(
            remembered,
            F.lit("<knowledge_context>\n"),
            F.col("_context"),
            F.lit("\n</knowledge_context>\n<question>\n"),
            escape_markup(strip(F.col("question"))),
            F.lit("\n</question>"),
        ).alias("user_prompt"),
        "n_sources",
    )


def _numbered_messages(messages: Column, label: str) -> Column:
    """Message elements with their 1-based index or stored ordinal, or the fixed none text."""
    kind = "array<struct<ordinal:bigint,role:string,content:string>>"
    lines = F.transform(
        F.coalesce(messages, F.array().cast(kind)),
        lambda m, i: F.concat(
            F.lit(f'<message {label}="'),
            (i + 1 if label == "index" else m["ordinal"]).cast("string"),
            F.lit('" role="'), m["role"], F.lit('">'), escape_markup(m["content"]),
            F.lit("</message>"),
        ),
    )
    return F.array_join(lines, "\n")


def _or_none(text: Column) -> Column:
    return F.when(F.length(text) > 0, text).otherwise(F.lit(NONE_TEXT))


def rewrite_inputs(df: DataFrame) -> DataFrame:
    """``model_input`` for question rewriting from ``question, summary, messages``."""
    return df.withColumn(
        "model_input",
        F.concat(
            F.lit("<conversation_summary>\n"),
            F.coalesce(escape_markup(F.col("summary")), F.lit(NONE_TEXT)),
            F.lit("\n</conversation_summary>\n<conversation_messages>\n"),
            _or_none(_numbered_messages(F.col("messages"), "index")),
            F.lit("\n</conversation_messages>\n<current_question>\n"),
            escape_markup(strip(F.col("question"))),
            F.lit("\n</current_question>"),
        ),
    )


def direct_inputs(df: DataFrame) -> DataFrame:
    """``model_input`` for answering without retrieval, from ``rewritten_question`` and memory."""
    return df.withColumn(
        "model_input",
        F.concat(
            F.lit("<conversation_memory>\n<summary>"),
            F.coalesce(escape_markup(F.col("summary")), F.lit(NONE_TEXT)),
            F.lit("</summary>\n"),
            _or_none(_numbered_messages(F.col("messages"), "index")),
            F.lit("\n</conversation_memory>\n<current_question>\n"),
            escape_markup(F.col("rewritten_question")),
            F.lit("\n</current_question>"),
        ),
    )


def summary_inputs(df: DataFrame) -> DataFrame:
    """``model_input`` for refreshing a summary from ``previous_summary, messages``."""
    return df.withColumn(
        "model_input",
        F.concat(
            F.lit("<previous_summary>\n"),
            F.coalesce(escape_markup(F.col("previous_summary")), F.lit(NONE_TEXT)),
            F.lit("\n</previous_summary>\n<messages>\n"),
            _numbered_messages(F.col("messages"), "ordinal"),
            F.lit("\n</messages>"),
        ),
    )


def intent_inputs(df: DataFrame, version: str, descriptions: dict[str, str]) -> DataFrame:
    """``model_input`` for intent scoring; the tree has three routes, so it is a literal."""
    tree = "\n".join(
        f'<intent name="{route}">{{{position}}}</intent>'
        for position, route in enumerate(descriptions)
    )
    head = [F.lit('<intent_tree version="'), escape_markup(F.lit(version)), F.lit('">\n')]
    for position, text in enumerate(descriptions.values()):
        before, tree = tree.split(f"{{{position}}}", 1)
        head += [F.lit(before), escape_markup(F.lit(text))]
    head += [F.lit(tree), F.lit("\n</intent_tree>\n<rewritten_question>\n")]
    return df.withColumn(
        "model_input",
        F.concat(*head, escape_markup(strip(F.col("rewritten_question"))),
                 F.lit("\n</rewritten_question>")),
    )
