"""Repair of damaged conversations by a run-length dynamic program over role and fault symbols.

Every row of a conversation is one symbol: its role (user, assistant, system, other) and whether it
must go (blank, or a copy of an earlier row) or is truncated. The cheapest edits that leave the role
initials ``(s?(ua)+)?`` are paths of an automaton with four states, so a row is a 4 x 4 matrix of
costs in the min-plus sense, a run of equal rows a power of it. Powers of two are cached; costs to
go pass over a run through them, and the choices are unrolled forwards, least letter first among
the cheapest, with the choices of powers cached as well.

A conversation may hold any share of all rows. Rows are reduced to symbols beside a text hash before they
are sorted; copies are found by an aggregate and a join, not inside a group; conversations above
``HOT_ROWS`` rows are cut into ranges of turns whose matrices are multiplied, so each range is its
own task. Texts are sorted once at the end and read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.encoding import tidy
from askgrid.plans.shared import written

HOT_ROWS = 1_000_000
#: The longest conversations above that size, so that their list may be broadcast; a conversation
#: beyond the list holds less than a ten-thousandth of all rows.
HOT_KEYS = 10_000
RANGES = 256

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States: nothing yet, after the system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "assistant", "system")
GONE = 0
_FAR = 1 << 60

Vector = tuple[int, int, int, int]


def symbol(role: int, truncated: bool) -> int:
    """The symbol of a row that may stay; role 0 user, 1 assistant, 2 system, 3 any other."""
    return 1 + 2 * role + truncated


# --- the dynamic program ------------------------------------------------------------------------

def edits(sign: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of each edit of one row, by letter; inserting takes no row."""
    yield "D", DELETE, state
    yield "I", INSERT, NEXT[state]
    if sign == GONE:
        return
    role, extra = (sign - 1) // 2, (sign - 1) % 2 * CUT_OFF
    if (role == 0 and state != USER) or (role == 1 and state == USER):
        yield "K", KEEP + extra, NEXT[state]
    if role == 2 and state == EMPTY:
        yield "K", KEEP + extra, SYSTEM
    yield "R", REROLE + extra, NEXT[state]


def _inserting(costs: list[int]) -> Vector:
    """Costs to go where rows may be inserted first; three insertions come back to a state."""
    for _ in range(3):
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in STATES]
    return tuple(costs)


END: Vector = _inserting([0, _FAR, _FAR, 0])


def _row_matrix(sign: int) -> np.ndarray:
    """``[from, to]`` costs of one row, with insertions before it."""
    columns = []
    for to in STATES:
        ahead = [_FAR] * 4
        for q in STATES:
            for letter, cost, then in edits(sign, q):
                if letter != "I" and then == to:
                    ahead[q] = min(ahead[q], cost)
        columns.append(_inserting(ahead))
    return np.array(columns, np.int64).T


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


@lru_cache(maxsize=None)
def power(sign: int, k: int) -> tuple[Vector, ...]:
    """The matrix of ``2**k`` equal rows: at most nine symbols and as many powers as bits."""
    if k == 0:
        matrix = _row_matrix(sign)
    else:
        half = np.array(power(sign, k - 1))
        matrix = times(half, half)
    return tuple(tuple(int(x) for x in row) for row in matrix)


def _before(matrix: tuple[Vector, ...], after: Vector) -> Vector:
    a, b, c, d = after
    return tuple(min(w + a, x + b, y + c, z + d, _FAR) for w, x, y, z in matrix)


def _bits(length: int) -> list[int]:
    return [k for k in range(length.bit_length()) if length >> k & 1]


def run_before(sign: int, length: int, after: Vector) -> Vector:
    """Costs to go before a run, from those after it."""
    for k in _bits(length):
        after = _before(power(sign, k), after)
    return after


def run_matrix(sign: int, length: int) -> np.ndarray:
    out = None
    for k in _bits(length):
        matrix = np.array(power(sign, k))
        out = matrix if out is None else times(out, matrix)
    return out


def _level(costs: Vector) -> Vector:
    low = min(costs)
    return costs if low == 0 else tuple(c - low if c < _FAR else _FAR for c in costs)


@lru_cache(maxsize=1 << 16)
def _choices(sign: int, k: int, state: int, after: Vector) -> tuple[str, int]:
    """Letters and last state of ``2**k`` equal rows, for levelled costs to go after them."""
    if k:
        middle = _level(_before(power(sign, k - 1), after))
        left, between = _choices(sign, k - 1, state, middle)
        right, then = _choices(sign, k - 1, between, after)
        return left + right, then
    here, letters = _before(power(sign, 0), after), ""
    while True:
        for letter, cost, then in edits(sign, state):
            rest = here[then] if letter == "I" else after[then]
            if cost + rest == here[state]:
                letters, state = letters + letter, then
                break
        if letter != "I":
            return letters, state


#: Longer powers are put together from these, so that cached strings stay short.
_CACHED = 10


def unroll(signs: bytes, lengths: list[int], state: int, after: Vector) -> tuple[str, int]:
    """The edit letters of runs of rows, and the state behind them."""
    pieces: list[tuple[int, int]] = []
    for sign, length in zip(signs, lengths):
        pieces += [(sign, _CACHED)] * (length >> _CACHED)
        pieces += [(sign, k) for k in _bits(length & ((1 << _CACHED) - 1))]
    costs = [_level(after)]
    for sign, k in reversed(pieces):
        costs.append(_level(_before(power(sign, k), costs[-1])))
    letters = []
    for (sign, k), behind in zip(pieces, reversed(costs[:-1])):
        some, state = _choices(sign, k, state, behind)
        letters.append(some)
    return "".join(letters), state


def closing(state: int) -> str:
    """The insertions that end a conversation in ``state``."""
    letters, costs = "", END[state]
    while costs:
        letters, state = letters + "I", NEXT[state]
        costs -= INSERT
    return letters


@lru_cache(maxsize=1 << 15)
def _whole(signs: bytes, lengths: tuple[int, ...]) -> tuple[int, str]:
    """Cost and letters of a whole conversation."""
    costs = END
    for sign, length in zip(reversed(signs), reversed(lengths)):
        costs = run_before(sign, length, costs)
    letters, state = unroll(signs, list(lengths), EMPTY, END)
    return costs[EMPTY], letters + closing(state)


def repair_symbols(signs: bytes) -> tuple[int, str]:
    """Cost and edit letters of one conversation, from the symbols of its rows."""
    runs, lengths = _runs(np.frombuffer(signs, np.uint8))
    return _whole(runs, tuple(lengths))


def _runs(codes: np.ndarray) -> tuple[bytes, list[int]]:
    if not codes.size:
        return b"", []
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts].tobytes(), np.diff(starts, append=codes.size).tolist()


# --- rows to symbols ----------------------------------------------------------------------------

_FILLED = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The columns that are read, nulls as one space; ``key`` is the conversation as a string."""
    return rows.select(
        F.col(conv).alias("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("null")).alias("key"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _marks(rows: DataFrame) -> DataFrame:
    """Different rows with their number, without texts."""
    blank = ~F.col("text").rlike(_FILLED)
    cut = ~F.col("text").rlike(_ENDED)
    initial = F.substring("role", 1, 1)
    place = (F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2)
             .otherwise(3))
    return (
        rows.select("key", "turn", "role", "digest", place.cast("tinyint").alias("place"),
                    blank.alias("blank"), cut.alias("cut"))
        .groupBy("key", "turn", "role", "digest", "place", "blank", "cut")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _with_copies(marks: DataFrame) -> DataFrame:
    """``copy``: whether role and text were seen at an earlier turn."""
    again = (
        marks.groupBy("key", "role", "digest")
        .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"),
             F.count(F.lit(1)).alias("times"))
        .where("times > 1").drop("times")
    )
    return marks.join(again, ["key", "role", "digest"], "left").withColumn(
        "copy", F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn")))


def _sizes(marks: DataFrame) -> DataFrame:
    """``key, n_rows, gaps`` per conversation."""
    return (
        marks.groupBy("key", "turn").agg(F.sum("n").alias("n"))
        .groupBy("key").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
            .cast("bigint").alias("gaps"))
    )


@dataclass(frozen=True)
class _Blocks:
    """The cut of the longest conversations into ranges of turns; all others are one range."""

    hot: DataFrame | None
    cuts: list[int]

    @staticmethod
    def of(marks: DataFrame, sizes: DataFrame, hot_rows: int) -> _Blocks:
        hot = (sizes.where(F.col("n_rows") > hot_rows).orderBy(F.col("n_rows").desc(), "key")
               .limit(HOT_KEYS).select("key"))
        names = [r["key"] for r in hot.collect()]
        if not names:
            return _Blocks(None, [])
        hot = sizes.sparkSession.createDataFrame([(n,) for n in names], "key string")
        steps = ", ".join(f"{i / RANGES!r}D" for i in range(1, RANGES))
        # One evaluation, used by all readers. Where the cuts fall changes balance, not results.
        found = marks.join(F.broadcast(hot), "key", "left_semi").agg(
            F.expr(f"percentile_approx(turn, array({steps}), {4 * RANGES})")).first()[0]
        return _Blocks(hot.withColumn("is_hot", F.lit(True)), sorted(set(found or [])))

    def cut(self, rows: DataFrame) -> DataFrame:
        if self.hot is None:
            return rows.withColumn("block", F.lit(0)).withColumn("is_hot", F.lit(False))
        cuts = F.array(*[F.lit(c).cast("bigint") for c in self.cuts]).cast("array<bigint>")
        below = F.size(F.filter(cuts, lambda c: c < F.col("turn")))
        return (
            rows.join(F.broadcast(self.hot), "key", "left")
            .withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
            .withColumn("block", F.when(F.col("is_hot") & F.col("turn").isNotNull(), below)
                        .otherwise(0)))


# --- fragments ----------------------------------------------------------------------------------

_FRAGMENT = ("key string, block int, is_hot boolean, signs binary, lengths array<bigint>, "
             "matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint, "
             "illegal bigint, first int, last int")
#: Pairs of neighbouring roles that may follow each other, by their places.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[2, 0] = _LEGAL[0, 1] = _LEGAL[1, 0] = True


def _fragment(key: str, block: int, hot: bool, place: np.ndarray, blank: np.ndarray,
              cut: np.ndarray, copy: np.ndarray, n: np.ndarray) -> dict:
    """One conversation, or one range of a long one, as runs of symbols and counts."""
    ok = ~(blank | copy)
    codes = np.where(ok, 1 + 2 * place + cut, GONE).astype(np.uint8)
    more = n - 1
    if more.any():  # further copies of a row follow it
        both = np.stack([codes, np.zeros_like(codes)], axis=1).ravel()
        codes = np.repeat(both, np.stack([np.ones_like(n), more], axis=1).ravel())
    signs, lengths = _runs(codes)
    matrix = None
    if hot:
        for sign, length in zip(signs, lengths):
            run = run_matrix(sign, length)
            matrix = run if matrix is None else times(matrix, run)
        matrix = matrix.ravel().tolist()
    return {
        "key": key, "block": block, "is_hot": hot, "signs": signs, "lengths": lengths,
        "matrix": matrix, "blank": int(n[blank].sum()),
        "duplicate": int(n[copy & ~blank].sum() + more[ok].sum()),
        "truncated": int((cut & ok).sum()),
        "illegal": int((~_LEGAL[place[:-1], place[1:]]).sum()
                       + (more * ~_LEGAL[place, place]).sum()),
        "first": int(place[0]), "last": int(place[-1]),
    }


_FRAGMENT_ARROW = pa.schema([
    ("key", pa.string()), ("block", pa.int32()), ("is_hot", pa.bool_()), ("signs", pa.binary()),
    ("lengths", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64())), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.int32()), ("last", pa.int32())])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows as groups of one (key, block); a group may span batches."""
    current, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(0).to_pylist(), object)
        blocks = np.asarray(batch.column(1))
        values = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False))
                  for i in range(3, 8)]
        hot = batch.column(2)
        starts = np.flatnonzero(np.concatenate(
            [[True], (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])]))
        for start, stop in zip(starts, [*starts[1:], len(keys)]):
            head = (keys[start], int(blocks[start]), hot[int(start)].as_py())
            if head != current:
                if current is not None:
                    yield current, parts
                current, parts = head, []
            parts.append([v[start:stop] for v in values])
    if current is not None:
        yield current, parts


@tidy
def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for head, parts in _groups(batches):
        place, blank, cut, copy, n = (np.concatenate(v) for v in zip(*parts))
        out.append(_fragment(*head, place, blank, cut, copy, n))
        if len(out) == 2_000:
            yield pa.RecordBatch.from_pylist(out, _FRAGMENT_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _FRAGMENT_ARROW)


def _fragments(marks: DataFrame, blocks: _Blocks) -> DataFrame:
    return (
        blocks.cut(_with_copies(marks))
        .select("key", "block", "is_hot", "place", "blank", "cut", "copy", "n", "turn", "role",
                "digest")
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", F.col("turn").asc_nulls_first(), "role", "digest")
        .select("key", "block", "is_hot", "place", "blank", "cut", "copy", "n")
        .mapInArrow(_fold, _FRAGMENT)
    )


# --- long conversations: ranges linked by their matrices ------------------------------------------

def _costs_to_go(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per range of one conversation, the costs to go behind it; the first has the whole cost."""
    pdf = pdf.sort_values("block", ignore_index=True)
    after, out = END, []
    for matrix in pdf["matrix"][::-1]:
        rows = tuple(tuple(int(x) for x in row) for row in np.reshape(matrix, (4, 4)))
        before = _before(rows, after)
        out.append((list(after), before[EMPTY]))
        after = before
    out.reverse()
    return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "after": [o[0] for o in out],
                         "cost": [o[1] if i == 0 else 0 for i, o in enumerate(out)]})


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per range of one conversation, the state it starts in."""
    pdf = pdf.sort_values("block", ignore_index=True)
    state, out = EMPTY, []
    for ends in pdf["ends"]:
        out.append(state)
        state = int(ends[state])
    return pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "state": out,
                         "is_last": [i == len(out) - 1 for i in range(len(out))]})


@tidy
def _every_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters and last state of a range for each state it may start in."""
    for batch in batches:
        ends, letters = [], []
        for signs, lengths, after in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            tried = [unroll(signs, lengths, q, tuple(after)) for q in STATES]
            letters.append([t[0] for t in tried])
            ends.append([t[1] for t in tried])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int32())),
             pa.array(letters, pa.list_(pa.string()))], names=["key", "block", "ends", "letters"])


def _long_plans(fragments: DataFrame) -> DataFrame:
    """``key, block, letters, state, cost`` of the ranges of long conversations.

    A group holds one small row per range (at most ``RANGES``), never rows of the conversation.
    """
    hot = fragments.where("is_hot")
    ahead = written(hot.select("key", "block", "matrix").groupBy("key").applyInPandas(
        _costs_to_go, "key string, block int, after array<bigint>, cost bigint"))
    tried = written(
        hot.join(ahead, ["key", "block"]).select("key", "block", "signs", "lengths", "after")
        .mapInArrow(_every_entry,
                    "key string, block int, ends array<int>, letters array<string>"))
    entries = tried.select("key", "block", "ends").groupBy("key").applyInPandas(
        _entries, "key string, block int, state int, is_last boolean")
    tail = F.element_at(F.array(*[F.lit(closing(q)) for q in STATES]), F.get("ends", "state") + 1)
    return (
        tried.join(entries, ["key", "block"])
        .join(ahead.select("key", "block", "cost"), ["key", "block"])
        .select("key", "block", F.concat(
            F.get("letters", "state"), F.when(F.col("is_last"), tail).otherwise("")
        ).alias("letters"), "state", "cost")
    )


@tidy
def _plan_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans = [_whole(signs, tuple(lengths))
                 for signs, lengths in zip(batch.column(1).to_pylist(),
                                           batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([0] * len(plans), pa.int32()),
             pa.array([p[1] for p in plans], pa.string()),
             pa.array([EMPTY] * len(plans), pa.int32()),
             pa.array([p[0] for p in plans], pa.int64())],
            names=["key", "block", "letters", "state", "cost"])


# --- edits applied ------------------------------------------------------------------------------

class _Editor:
    """Applies the letters of one fragment to its rows, which come in order."""

    def __init__(self, letters: str, state: int):
        self.letters, self.at, self.state = letters, 0, state

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            yield "I", self._turned(), ""
            self.at += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            if role.startswith("s"):
                self.state = SYSTEM
            else:
                self.state = NEXT[self.state]
            yield letter, role, text
        elif letter == "R":
            yield letter, self._turned(), text
        else:
            yield letter, None, None

    def _turned(self) -> str:
        self.state = NEXT[self.state]
        return ROLES[0] if self.state == USER else ROLES[1]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(key, block, turn, letter, role, text)`` from sorted rows, each fragment's letters first."""
    editor, place = None, None
    for batch in batches:
        for key, block, letters, state, turn, role, text in zip(
                *(batch.column(i).to_pylist() for i in range(7))):
            if letters is not None:
                if editor is not None:
                    yield from ((*place, None, *e) for e in editor.inserted())
                editor, place = _Editor(letters, state), (key, block)
                continue
            yield from ((*place, turn, *e) for e in editor.row(role, text))
    if editor is not None:
        yield from ((*place, None, *e) for e in editor.inserted())


@tidy
def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("block", pa.int32()), ("place", pa.int64()),
                        ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                        ("text", pa.string())])
    out, held, before, place = [], 0, None, 0
    for key, block, turn, letter, role, text in _edited(batches):
        place = place + 1 if (key, block) == before else 0
        before = key, block
        out.append({"key": key, "block": block, "place": place, "turn": turn, "edit": letter,
                    "role": role, "text": text})
        held += len(text or "") + 64
        if held > 2 << 20:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


@tidy
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, audit, repaired_sha256`` of conversations, read as a stream of their rows."""
    def ready(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)],
                                          names=["key", "audit", "repaired_sha256"])

    found, current, letters, hashed, begun = [], None, [], None, False
    for key, _, _, letter, role, text in _edited(batches):
        if key != current:
            if current is not None:
                found.append((current, "".join(letters), hashed.hexdigest()))
                if len(found) == 5_000:
                    yield ready(found)
                    found = []
            current, letters, hashed, begun = key, [], hashlib.sha256(), False
        letters.append(letter)
        if role is not None:
            hashed.update((("\n" if begun else "") + f"{role}:{text}").encode())
            begun = True
    if current is not None:
        found.append((current, "".join(letters), hashed.hexdigest()))
    if found:
        yield ready(found)


@dataclass(frozen=True)
class RepairPlan:
    """The edits of all conversations: ``fragments`` with counts, ``plans`` with edit letters."""

    rows: DataFrame
    sizes: DataFrame
    fragments: DataFrame
    plans: DataFrame
    blocks: _Blocks

    def _stream(self, by: list[str]) -> DataFrame:
        """Rows in order, the letters of a fragment before its rows."""
        texts = self.blocks.cut(self.rows).select(
            "key", "block", F.lit(None).cast("string").alias("letters"),
            F.lit(None).cast("int").alias("state"), "turn", "role", "text", "digest",
            F.lit(1).alias("kind"))
        heads = self.plans.select(
            "key", "block", "letters", "state", F.lit(None).cast("bigint").alias("turn"),
            F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
            F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("kind"))
        return (
            heads.unionByName(texts).repartition(*by)
            .sortWithinPartitions("key", "block", "kind", F.col("turn").asc_nulls_first(),
                                  "role", "digest")
            .select("key", "block", "letters", "state", "turn", "role", "text"))

    def repaired(self) -> DataFrame:
        """``key, block, place, turn, edit, role, text``: every edit in order.

        Deleted rows have null role and text, inserted rows null turn. Ranges of long conversations
        are separate tasks; (block, place) is the order inside a conversation.
        """
        return self._stream(["key", "block"]).mapInArrow(
            _apply, "key string, block int, place bigint, turn bigint, edit string, role string, "
                    "text string")

    def digests(self) -> DataFrame:
        """``key, audit, repaired_sha256``; one digest needs one pass over its conversation."""
        return self._stream(["key"]).mapInArrow(
            _digest, "key string, audit string, repaired_sha256 string")


def plan_repairs(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    hot_rows: int = HOT_ROWS,
) -> RepairPlan:
    """The cheapest edits of every conversation.

    Rows are taken by turn (null first), rows of one turn by role, then by the SHA-256 of the text;
    equal rows cannot be told apart, so their order does not matter. Null role or text counts as one
    space. A null conversation id is a conversation of its own. Other columns are not read, so their
    names cannot clash. An empty table gives no conversations.
    """
    kept = _rows(rows, conv_col, turn_col, role_col, text_col)
    marks = written(_marks(kept))
    sizes = written(_sizes(marks))
    blocks = _Blocks.of(marks, sizes, hot_rows)
    fragments = written(_fragments(marks, blocks))
    plans = fragments.where("not is_hot").select("key", "signs", "lengths").mapInArrow(
        _plan_whole, "key string, block int, letters string, state int, cost bigint")
    if blocks.hot is not None:
        plans = plans.unionByName(_long_plans(fragments))
    return RepairPlan(kept, sizes, fragments, written(plans), blocks)


def repair_report(plan: RepairPlan, conversations: DataFrame, conv_col: str = "conv_id"
                  ) -> DataFrame:
    """One row per id of ``conversations``, with what its repair took.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: missing
    turns, rows by their first fault, neighbouring roles that may not follow each other, the cost
    and letters of the cheapest edits (least string among equals), and the digest of the repaired
    ``role:text`` lines. An id without rows has zeros, no letters and the digest of nothing.
    """
    every = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null"))
        .alias("key")).distinct()
    # Where two ranges of a long conversation meet, their outer roles are neighbours as well.
    legal = F.lit(",".join(f"{a}{b}" for a, b in np.argwhere(_LEGAL)))
    ends = F.sort_array(F.collect_list(F.struct("block", "first", "last")))
    counts = (
        plan.fragments.groupBy("key").agg(
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
            ends.alias("ends"))
        .withColumn("seams", F.transform("ends", lambda e, i: F.concat(
            e["last"].cast("string"), F.get(F.col("ends"), i + 1)["first"].cast("string"))))
        .select("key", "blank", "duplicate", "truncated", (
            F.col("illegal") + F.size(F.filter("seams", lambda p: ~F.contains(legal, p)))
        ).alias("illegal")))
    costs = plan.plans.groupBy("key").agg(F.sum("cost").alias("cost"))
    joined = every
    for part in (plan.sizes.select("key", "gaps"), counts, costs, plan.digests()):
        joined = joined.join(part, "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).cast("bigint").alias(c)
          for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
