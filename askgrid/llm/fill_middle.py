"""Fill-in-the-middle documents, cut at token boundaries through a learned rank index.

The boundaries of a text are the code-point offsets at which its tokens (runs of ASCII letters, or
single other characters) start, and its end. Over all of them an index is fitted: straight segments
from rank to offset whose error stays within ``BOUND``, and the residual of every boundary in one
byte. A cut at rank ``r`` is the prediction of the segment holding ``r`` plus the stored residual,
which is exact. Segments are fitted with array operations over all texts of a batch at once: spans
of ranks are tried with the line through their ends, and those that miss the bound are halved.

A document never leaves its row, so nothing is shuffled and nothing depends on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.encoding import slices, tidy

BOUND = 100
SPAN = 512
PLAIN_FROM = 90
SUFFIX_FIRST_BELOW = 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


@dataclass(frozen=True)
class Boundaries:
    """Boundary offsets of several texts in a row; text ``d`` has ``first[d]`` to ``first[d+1]``."""

    offsets: np.ndarray
    first: np.ndarray

    @property
    def tokens(self) -> np.ndarray:
        return np.diff(self.first) - 1


def token_boundaries(texts: pa.Array) -> Boundaries:
    """All boundaries of all texts, in code points; an empty or null text has the one at 0."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    letter = _LETTER[data]
    goes_on = letter.copy()
    goes_on[1:] &= letter[:-1]
    goes_on[ends[:-1][np.diff(ends) > 0]] = False
    is_character = (data & 0xC0) != 0x80
    characters = np.zeros(data.size + 1, np.int64)
    np.cumsum(is_character, out=characters[1:])
    starts = np.flatnonzero(is_character & ~goes_on)
    tokens = np.diff(np.searchsorted(starts, ends))
    first = np.zeros(tokens.size + 1, np.int64)
    np.cumsum(tokens + 1, out=first[1:])
    offsets = np.empty(first[-1], np.int64)
    is_end = np.zeros(first[-1], bool)
    is_end[first[1:] - 1] = True
    begin = characters[ends[:-1]]
    offsets[~is_end] = characters[starts] - np.repeat(begin, tokens)
    offsets[is_end] = characters[ends[1:]] - begin
    return Boundaries(offsets, first)


@dataclass(frozen=True)
class RankIndex:
    """Segments ``(start, base, slope)`` over flat ranks, and one residual for each rank."""

    starts: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def predict(self, at: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.starts, at, side="right") - 1
        return _line(self.bases[segment], self.slopes[segment], at - self.starts[segment])

    def offset(self, at: np.ndarray) -> np.ndarray:
        """The exact offsets of the boundaries at the flat ranks ``at``."""
        return self.predict(at) + self.residuals[at]


def _line(base: np.ndarray, slope: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return base + np.rint(slope * steps).astype(np.int64)


def fit_rank_index(of: Boundaries, bound: int = BOUND, span: int = SPAN) -> RankIndex:
    """Segments of at most ``span`` ranks, none across texts, with errors of at most ``bound``.

    A segment of one or two ranks is exact, so halving ends; ``bound`` must fit a signed byte.
    """
    if not 0 <= bound <= 127:
        raise ValueError("bound must be between 0 and 127")
    values, total = of.offsets, of.offsets.size
    if not total:
        none = np.zeros(0, np.int64)
        return RankIndex(none, none, np.zeros(0), none.astype(np.int8))
    ranks = np.arange(total) - np.repeat(of.first[:-1], np.diff(of.first))
    starts = np.flatnonzero(ranks % span == 0)
    while True:
        lengths = np.diff(starts, append=total)
        bases = values[starts]
        slopes = (values[starts + lengths - 1] - bases) / np.maximum(lengths - 1, 1)
        steps = np.arange(total) - np.repeat(starts, lengths)
        residuals = values - _line(np.repeat(bases, lengths), np.repeat(slopes, lengths), steps)
        misses = np.maximum.reduceat(np.abs(residuals), starts) > bound
        if not misses.any():
            return RankIndex(starts, bases, slopes, residuals.astype(np.int8))
        starts = np.sort(np.concatenate([starts, starts[misses] + lengths[misses] // 2]))


def _transform(sentinels: tuple[str, str, str], plain_from: int, suffix_first_below: int):
    before, after, middle = sentinels

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, size in slices(batch.column(1)):
                part = batch.slice(start, size)
                found = token_boundaries(part.column(1))
                index = fit_rank_index(found)
                n = found.tokens
                h1, h2, h3, h4 = (np.asarray(part.column(2 + i)) for i in range(4))
                one, two = h1 % (n + 1), h2 % (n + 1)
                low = index.offset(found.first[:-1] + np.minimum(one, two)).tolist()
                high = index.offset(found.first[:-1] + np.maximum(one, two)).tolist()
                stays = (h3 % 100 >= plain_from).tolist()
                turned = (h4 % 100 < suffix_first_below).tolist()
                forms, lows, sizes, outputs = [], [], [], []
                for text, a, b, stay, turn in zip(
                        part.column(1).to_pylist(), low, high, stays, turned):
                    if not text or stay or any(s in text for s in sentinels):
                        forms.append("plain")
                        lows.append(None)
                        sizes.append(None)
                        outputs.append(text)
                        continue
                    lows.append(a)
                    sizes.append(b - a)
                    if turn:
                        forms.append("spm")
                        parts = (after, text[b:], before, text[:a], middle, text[a:b])
                    else:
                        forms.append("psm")
                        parts = (before, text[:a], after, text[b:], middle, text[a:b])
                    outputs.append("".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(forms), pa.array(lows, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(outputs, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def hash_groups(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    plain_from: int = PLAIN_FROM,
    suffix_first_below: int = SUFFIX_FIRST_BELOW,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row.

    ``n`` tokens are cut at two ranks drawn from the id. ``psm`` puts prefix, suffix and middle
    behind their sentinels, ``spm`` suffix, prefix and middle; ``plain`` keeps a text that is empty,
    holds a sentinel, or is drawn to stay (then without cuts: null). Null text counts as empty. A
    null id draws as the empty string and stays null. Repeated rows give repeated rows. Other
    columns are not read, so their names cannot clash. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[h.alias(f"h{i}") for i, h in enumerate(hash_groups(F.col(id_col), seed))])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _transform(sentinels, plain_from, suffix_first_below),
        f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
        "output string")


def restore(output: Column, form: Column,
            sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text an output was made of; a text with sentinels is ``plain``, so the parts are clear."""
    pattern = "|".join(f"\\Q{s}\\E" for s in sentinels)

    def joined(parts: Column) -> Column:
        first, second = F.get(parts, 1), F.get(parts, 2)
        middle = F.get(parts, 3)
        return F.when(form == "psm", F.concat(first, middle, second)).otherwise(
            F.concat(second, middle, first))

    parts = F.get(F.transform(F.array(F.split(output, pattern, -1)), joined), 0)
    return F.when(form == "plain", output).otherwise(parts)
