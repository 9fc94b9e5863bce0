"""Token codecs: how a text becomes tokens and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from askgrid.functions.text import WHITE


@dataclass(frozen=True)
class Codec:
    """``encode`` maps a text column to ``array<string>``; tokens join by ``joiner``.

    ``gap`` is the number of tokens the blank line between two packed blocks adds, so that the
    token count of joined text is the sum of the parts plus gaps. ``gap = None`` means counts do
    not add up (sub-word models); packing then asks ``encode_texts`` for whole joined texts.
    """

    model_id: str
    revision: str
    encode: Callable[[Column], Column]
    joiner: str
    gap: int | None = 0
    encode_texts: Callable[[list[str]], list[list[str]]] | None = None


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE + "+"), "")


def _chars(text: Column) -> Column:
    """Characters; splitting an empty text would give one empty token."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


WORDS = Codec("words", "1", _words, " ", gap=0)
CHARS = Codec("chars", "1", _chars, "", gap=2)


def user_codec(
    model_id: str,
    revision: str,
    encode_texts: Callable[[list[str]], list[list[str]]],
    joiner: str = "",
) -> Codec:
    """Wrap a tokenizer given as a list function; it runs on Arrow batches."""
    @F.pandas_udf(ArrayType(StringType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(encode_texts(texts.tolist()))

    return Codec(model_id, revision, encode, joiner, gap=None, encode_texts=encode_texts)


def resolve_codec(codec: str | Codec) -> Codec:
    if isinstance(codec, Codec):
        return codec
    return {"words": WORDS, "chars": CHARS}[codec]


def codec_mismatch(codec: Codec, model_id: Column, revision: Column) -> Column:
    """True where an index was embedded by another model than the tokenizer's."""
    return ~(model_id.eqNullSafe(codec.model_id) & revision.eqNullSafe(codec.revision))


__all__ = ["CHARS", "WORDS", "Codec", "codec_mismatch", "resolve_codec", "user_codec"]
