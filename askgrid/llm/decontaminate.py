"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are normalised to words (``A-Z`` lowered; letters, digits and all non-ASCII characters make
words). Every word of the benchmark becomes a symbol, every window of ten words a pattern of ten symbols,
and a document a string of symbols that the automaton reads once. A match ends at a word
number; word numbers map back to code-point offsets of the original text.

The automaton is sent to every task, so its size is checked first: a benchmark of more than
``MOST_WORDS`` words (or ``MOST_BYTES``) is dealt into shards of at most about that size, each with
its own automaton and its own scan, and the findings of a document are merged by a shuffle. Documents are
never shuffled and never paired with items.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.encoding import tidy
from askgrid.plans.shared import written

WIDTH = 10
#: Below the ``ALPHABET ** DIGITS`` symbols; an automaton takes up to 2 kB for each of them.
MOST_WORDS = 100_000
MOST_BYTES = 32 << 20
#: Longer items are windowed in overlapping pieces.
PIECE_WORDS = 10_000

#: Fixed value: what separates words, after lowering.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    else 0x20 for b in range(256))
_IS_WORD = np.array([b != 0x20 for b in _BYTES])
#: Characters of a word's symbol, and how many different ones each place has.
DIGITS, ALPHABET = 3, 64
#: What stands for a word that no item has.
_OTHER = "\x00"
_UNKNOWN = _OTHER * DIGITS

#: A passage: the words ``first`` to ``last`` (numbers from 0), code points ``start`` up to ``stop``.
_FIELDS = ("first", "last", "start", "stop")
_PASSAGES = pa.list_(pa.struct([(f, pa.int64()) for f in _FIELDS]))
_FOUND = ("n_words bigint, n_hit bigint, items array<string>, "
          "passages array<struct<first:bigint,last:bigint,start:bigint,stop:bigint>>")


def words_of(text: str) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode().translate(_BYTES).split()


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code-point offsets at which the words of a text start and stop."""
    data = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate([[False], _IS_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return characters[edges[::2]], characters[edges[1::2]]


class Scanner:
    """The automaton over the windows of ``(item, words)`` rows.

    The symbol of a word is ``DIGITS`` characters, one of each of as many disjoint alphabets: nodes
    then have few children, and matches start and end at whole words.
    """

    def __init__(self, items: Sequence[tuple[str, Sequence[bytes]]], width: int = WIDTH):
        self.symbols: dict[bytes, str] = {}
        windows: dict[str, set[str]] = {}
        for item, words in items:
            code = "".join(self._symbol(w) for w in words)
            for i in range(max(len(words) - width, 0) + 1 if words else 0):
                windows.setdefault(code[i * DIGITS:(i + width) * DIGITS], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, owners in windows.items():
            self.automaton.add_word(window, (len(window) // DIGITS, tuple(owners)))
        if windows:
            self.automaton.make_automaton()
        # No match holds a word that no item has: such words only reset the automaton, so only
        # stretches without them are read, if the shortest window fits.
        shortest = min(map(len, windows), default=DIGITS)
        self.stretches = re.compile(f"[^{_OTHER}]{{{shortest},}}").finditer if windows else None

    def _symbol(self, word: bytes) -> str:
        if word not in self.symbols:
            number, digits = len(self.symbols), []
            for place in range(DIGITS):
                number, digit = divmod(number, ALPHABET)
                digits.append(chr(1 + place * ALPHABET + digit))
            self.symbols[word] = "".join(digits)
        return self.symbols[word]

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit runs of word numbers (both ends included), items found."""
        words = words_of(text)
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.stretches is None or not words:
            return len(words), runs, items
        get = self.symbols.get
        code = "".join([get(w, _UNKNOWN) for w in words])
        seen: set[int] = set()
        for stretch in self.stretches(code):
            for end, value in self.automaton.iter(code, *stretch.span()):
                size, owners = value
                last = end // DIGITS
                first = last - size + 1
                while runs and runs[-1][1] >= first - 1:  # touching runs become one
                    first = min(first, runs.pop()[0])
                runs.append((first, last))
                if id(value) not in seen:
                    seen.add(id(value))
                    items.update(owners)
        return len(words), runs, items


_SCANNERS: dict[tuple[str, int], Scanner] = {}


def _scanner(shard, width: int) -> Scanner:
    """The automaton of a shipped shard; a worker keeps the last one."""
    name, items = shard
    if (name, width) not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[name, width] = Scanner(items.value, width)
    return _SCANNERS[name, width]


def _findings(keys: pa.Array, counts: list, items: list, passages: list) -> pa.RecordBatch:
    hits = [sum(p[1] - p[0] + 1 for p in of) for of in passages]
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
         pa.array([sorted(i) for i in items], pa.list_(pa.string())),
         pa.array([[dict(zip(_FIELDS, p)) for p in of] for of in passages], _PASSAGES)],
        names=["key", "n_words", "n_hit", "items", "passages"])


def _scan(shard, width: int, only_hits: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shard, width)
        for batch in batches:
            keep, counts, items, passages = [], [], [], []
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                n, runs, owners = scanner.scan(text)
                if only_hits and not runs:
                    continue
                keep.append(row)
                counts.append(n)
                items.append(owners)
                starts, stops = word_spans(text) if runs else ((), ())
                passages.append([(a, b, int(starts[a]), int(stops[b])) for a, b in runs])
            yield _findings(batch.column(0).take(pa.array(keep, pa.int64())), counts, items,
                            passages)

    return run


def item_words(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
               width: int = WIDTH) -> DataFrame:
    """``item, words`` of the items that have words; a long item in pieces with equal windows."""
    words = F.regexp_extract_all(
        F.translate(F.col(text_col), _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))
    pieces = F.sequence(F.lit(0), F.expr(
        f"cast((greatest(size(all_words) - {width - 1}, 1) - 1) div {PIECE_WORDS} as int)"))
    return (
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                         words.alias("all_words"))
        .where(F.size("all_words") > 0)
        .select("item", "all_words", F.explode(pieces).alias("piece"))
        .select("item", F.slice("all_words", F.col("piece") * PIECE_WORDS + 1,
                                PIECE_WORDS + width - 1).alias("words"))
    )


def _shards(benchmark: DataFrame, most_words: int) -> tuple[DataFrame, int]:
    """The items with their shard, and how many shards their counted size asks for."""
    size = benchmark.agg(
        F.sum(F.size("words")).alias("words"),
        F.sum(F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.octet_length(w)))
        .alias("bytes")).first()
    shards = max(1, -(-(size["words"] or 0) // most_words), -(-(size["bytes"] or 0) // MOST_BYTES))
    return benchmark.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards))), shards


def _shipped(items: DataFrame, shard: int):
    """A name for the shard and its items, sent to every task; their size was counted before."""
    rows = items.where(F.col("shard") == shard).select("item", "words").collect()
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(
        [(r["item"], [w.encode() for w in r["words"]]) for r in rows])


@tidy
def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Findings of several shards per row: passages that touch become one."""
    for batch in batches:
        items, passages = [], []
        for found, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            items.append({i for of in found for i in of})
            united: list[tuple] = []
            for p in sorted(tuple(p[f] for f in _FIELDS) for of in parts for p in of):
                if united and p[0] <= united[-1][1] + 1:
                    last = united.pop()
                    p = (last[0], max(last[1], p[1]), last[2], max(last[3], p[3]))
                united.append(p)
            passages.append(united)
        yield _findings(batch.column(0), batch.column(1).to_pylist(), items, passages)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """``doc_id, n_words, n_hit, items, passages`` of every row of ``docs``.

    ``passages`` are the runs of words that lie inside some occurrence of a window of ``width``
    consecutive item words (an item of fewer words is one window): first and last word number, and
    the code points of the original text. ``items`` are the different ids of the items found,
    sorted as strings. Null or wordless texts have no words and no passages, null or wordless items
    no windows; an item without id has the id ``''``; rows of one item id count as one item. A null
    document id stays null, repeated rows give repeated rows. Other columns are not read, so their
    names cannot clash. An empty table gives no rows, an empty benchmark finds nothing.
    """
    items, shards = _shards(item_words(benchmark, item_col, item_text_col, width), most_words)
    rows = docs.select(F.col(id_col).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    if shards == 1:
        found = rows.mapInArrow(_scan(_shipped(items, 0), width, False), f"key {kind}, {_FOUND}")
        return found.withColumnRenamed("key", "doc_id")
    # Written, so that the row keys of all scans are the same.
    keyed = written(rows.select(F.col("key").alias("doc_id"), "text",
                                F.monotonically_increasing_id().alias("key")))
    texts = keyed.select("key", "text")
    items = written(items)
    parts = [texts.mapInArrow(_scan(_shipped(items, shard), width, True), f"key bigint, {_FOUND}")
             for shard in range(shards)]
    merged = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("key").agg(F.max("n_words").alias("n_words"),
                            F.collect_list("items").alias("items"),
                            F.collect_list("passages").alias("passages"))
        .mapInArrow(_unite, f"key bigint, {_FOUND}"))
    words = F.regexp_count(F.translate("text", _UPPER, _UPPER.lower()), F.lit(WORD))
    return keyed.select("doc_id", "key", words.cast("bigint").alias("_words")).join(
        merged, "key", "left").select(
            "doc_id", F.coalesce("n_words", "_words").alias("n_words"),
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("passages", F.array().cast(
                "array<struct<first:bigint,last:bigint,start:bigint,stop:bigint>>"))
            .alias("passages"))


def redact(text: Column, passages: Column, mark: str = "") -> Column:
    """``text`` with its passages replaced by ``mark``."""

    def step(done: Column, p: Column) -> Column:
        kept = F.substring(text, done["at"] + 1, (p["start"] - done["at"]).cast("int"))
        return F.struct(F.concat(done["text"], kept, F.lit(mark)).alias("text"),
                        p["stop"].cast("int").alias("at"))

    begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    return F.aggregate(passages, begin, step, lambda done: F.concat(
        done["text"], F.substring(text, done["at"] + 1, F.length(text))))
