"""Exact, cached encoding of whole texts with a public tokenizer, for use inside tasks.

Byte-level and word-dropping BPE tokenizers first cut a text into pieces by a pattern and then
merge inside each piece. Their patterns never continue a match from a non-space character into
white space, nor from an ASCII letter into one of ``.,!?;:*$%&#``, and matching after such a place
does not look back. Texts are therefore cut there into units (vectorised over the UTF-8 bytes), each
different unit is encoded once by the library itself and kept in a bounded cache, and the ids are
gathered per text. The result equals encoding the whole text in one call.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Byte classes: 1 plain white space, 2 ASCII letter, 4 mark, 0 all else.
_CLASS = bytearray(256)
for _byte in (9, 10, 13, 32):
    _CLASS[_byte] = 1
for _byte in (*range(65, 91), *range(97, 123)):
    _CLASS[_byte] = 2
for _byte in b".,!?;:*$%&#":
    _CLASS[_byte] = 4
_ODD_SPACE = np.zeros(256, bool)
_ODD_SPACE[[11, 12, 28, 29, 30, 31]] = True

# A unit of Latin letters after at most one space is a single piece for the merges.
_PLAIN = re.compile(rb"[ \n]?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PROBES = ("word", " word", "Word", " Fröhlich", "été", " ça", "straße", "a", " I")

CACHED_BYTES = 48
CACHED_UNITS = 200_000


def load_tokenizer(file: str):
    """The tokenizer of ``file``; parallelism is Spark's business, so its threads are off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def _after_odd_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each byte position is white space beyond ASCII."""
    last = data[at - 1]
    out = _ODD_SPACE[last]
    wide = np.flatnonzero((last >= 0x80) & (at >= 2))
    if wide.size:
        p1, p2 = last[wide], data[at[wide] - 2]
        p3 = np.where(at[wide] >= 3, data[np.maximum(at[wide] - 3, 0)], 0)
        two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
        general = (p3 == 0xE2) & (p2 == 0x80) & (
            (p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
        rest = ((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)) | (
            (p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)) | (
            (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80))
        out[wide] |= two | general | rest
    return out


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Whether every supported tokenizer surely starts afresh at each byte position of ``data``."""
    starts = np.zeros(data.size, bool)
    if data.size < 2:
        return starts
    kind = np.frombuffer(data.tobytes().translate(bytes(_CLASS)), np.uint8)
    to_space = np.flatnonzero((kind[1:] == 1) & (kind[:-1] != 1)) + 1
    starts[1:] = (kind[1:] == 4) & (kind[:-1] == 2)
    starts[to_space[~_after_odd_space(data, to_space)]] = True
    return starts


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _kept(unit: bytes) -> str:
    return unit.decode("latin-1").translate(_LETTERS)


def _lowered(unit: bytes) -> str:
    return unit.decode("utf-8").strip(" \n").lower().encode("utf-8").decode("latin-1").translate(
        _LETTERS)


@dataclass
class Encoded:
    """Flat ids of a batch of texts: text ``i`` owns ``ids[offsets[i]:offsets[i + 1]]``."""

    ids: np.ndarray
    offsets: np.ndarray


class Encoder:
    """Encodes Arrow string arrays; null counts as empty. One instance lives in each worker."""

    def __init__(self, file: str, counts_only: bool = False) -> None:
        self.tokenizer = load_tokenizer(file)
        self.counts_only = counts_only
        self._model = self.tokenizer.model
        self._piece = self._piece_form()
        self._young: dict = {}
        self._old: dict = {}

    def _piece_form(self):
        """How a plain unit reads for the merges; None unless the library agrees on the probes."""
        for form in (_kept, _lowered):
            if all(
                [t.id for t in self._model.tokenize(form(p.encode("utf-8")))]
                == self.tokenizer.encode(p, add_special_tokens=False).ids
                for p in _PROBES
            ):
                return form
        return None

    def _encode_units(self, units: list[bytes]) -> list:
        known, young, old = [None] * len(units), self._young, self._old
        form, tokenize, plain = self._piece, self._model.tokenize, _PLAIN.fullmatch
        missing = []
        for i, unit in enumerate(units):
            value = young.get(unit)
            if value is None:
                value = old.get(unit)
                if value is None:
                    if form is None or len(unit) > CACHED_BYTES or not plain(unit) or (
                            form is _kept and unit[0] == 10):
                        missing.append(i)
                        continue
                    pieces = tokenize(form(unit))
                    value = len(pieces) if self.counts_only else array(
                        "I", [t.id for t in pieces]).tobytes()
                young[unit] = value
            known[i] = value
        for lo in range(0, len(missing), 4096):
            block = missing[lo:lo + 4096]
            encoded = self.tokenizer.encode_batch_fast(
                [units[i].decode("utf-8") for i in block], add_special_tokens=False)
            for i, e in zip(block, encoded):
                value = len(e) if self.counts_only else array("I", e.ids).tobytes()
                known[i] = value
                if len(units[i]) <= CACHED_BYTES:
                    young[units[i]] = value
        if len(young) > CACHED_UNITS:
            self._old, self._young = young, {}
        return known

    def _units(self, texts: pa.Array):
        """Codes into a list of different units, and the first unit of each text."""
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        texts = pa.concat_arrays([texts])
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        low, high = int(bounds[0]), int(bounds[-1])
        raw = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.empty(0, np.uint8)
        bounds = bounds - low
        starts = np.append(unit_starts(raw), True)
        starts[bounds] = True
        edges = np.flatnonzero(starts)
        first = np.searchsorted(edges, bounds)
        if len(edges) < 2:
            return np.empty(0, np.int64), [], first
        parts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1,
            [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(raw)])
        coded = parts.dictionary_encode()
        _, ends, held = coded.dictionary.buffers()
        ends, held = np.frombuffer(ends, np.int64).tolist(), held.to_pybytes()
        units = [held[a:b] for a, b in zip(ends, ends[1:len(coded.dictionary) + 1])]
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), units, first

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        codes, units, first = self._units(texts)
        if not units:
            return np.zeros(len(texts), np.int64)
        known = self._encode_units(units)
        each = np.array(known if self.counts_only else [len(x) // 4 for x in known], np.int64)
        total = np.concatenate([[0], np.cumsum(each[codes])])
        return total[first[1:]] - total[first[:-1]]

    def ids(self, texts: pa.Array) -> Encoded:
        """Ids of each text."""
        codes, units, first = self._units(texts)
        if not units:
            return Encoded(np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        known = self._encode_units(units)
        size = np.array([len(x) // 4 for x in known], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = np.frombuffer(b"".join(known), "<u4")
        per = size[codes]
        ends = np.cumsum(per)
        total = np.concatenate([[0], ends])
        places = np.repeat(start[codes] - (ends - per), per)
        places += np.arange(places.size)
        return Encoded(flat[places], total[first])


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(file: str, counts_only: bool = False) -> Encoder:
    """The worker's encoder for ``file``; kept between tasks while the worker lives."""
    key = (file, counts_only)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(file, counts_only)
    return _ENCODERS[key]


def _trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A batch function for Arrow maps whose worker is idle without holding freed memory.

    Workers outlive tasks and stages; what one stage has freed must not crowd out the next.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def slices(texts: pa.Array, most: int = 2 << 20):
    """``(start, length)`` pieces of a text array holding about ``most`` bytes each, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield start, stop - start
        start = stop
