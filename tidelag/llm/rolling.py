"""Numpy kernels over slices of document bytes: words, lines and hashes of any span.

A slice holds whole documents back to back. The hash of a span is a difference of two
prefix sums, so hashing every window of a slice costs a few passes over it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
FOLD = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)

_bytes = np.arange(256)
#: \x20 and \x09-\x0D
IS_SPACE = (_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D))
BYTE_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


@dataclass
class Slice:
    """``rows``: the batch's rows; ``buf``: their texts as UTF-8; ``off``: where each begins, and the end."""

    rows: pa.RecordBatch
    buf: np.ndarray
    off: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.off)


def slices(batches: Iterator[pa.RecordBatch], text: str = "_text", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut batches into slices of at most ``limit`` bytes; a longer document is a slice of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(column):
            continue
        data = column.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield Slice(batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        have = np.empty(size + 1, np.uint64)
        have[0] = 1
        np.cumprod(np.full(size, base % 2**64, np.uint64), out=have[1:])
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits."""
    x = (x ^ (x >> SHIFT)) * FOLD
    x = (x ^ (x >> SHIFT)) * FOLD
    return x ^ (x >> SHIFT)


class Spans:
    """Hashes of spans [start, end) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n)[:n], out=self.sums[1:])
        self.back = powers(n, pow(BASE, -1, 2**64))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (np.asarray(end) - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + length * FOLD)

    def windows(self, width: int) -> np.ndarray:
        """Hashes of [0, width), [1, width + 1), ..."""
        count = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:count]) * self.back[:count] + np.uint64(width * int(FOLD) % 2**64))


def byte_spans(buf: np.ndarray) -> Spans:
    return Spans(BYTE_VALUES[buf])


@dataclass
class Words:
    """``start``, ``end``: byte bounds of all words; ``first``: index of each document's first word, and the end."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(part: Slice) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``; no word crosses documents."""
    n = len(part.buf)
    solid = ~IS_SPACE[part.buf]
    cut = np.zeros(n + 1, bool)
    cut[part.off] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:n]
    ends[:-1] &= ~solid[1:] | cut[1:n]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, part.off))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers, then those of the next."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)


def covered(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``length`` places lie in at least one span [start, end)."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words at the given byte bounds, joined by one space."""
    data = buf.tobytes()
    return b" ".join([data[s:e] for s, e in zip(start.tolist(), end.tolist())])


def text_array(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive stretches of ``data`` as strings or binary values."""
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def spaced(part: Slice, found: Words, keep: np.ndarray) -> pa.Array:
    """Of each document the kept words, joined by one space."""
    start, size, doc = found.start[keep], (found.end - found.start)[keep] + 1, found.doc[keep]
    out = np.append(part.buf, np.uint8(0x20))[ranges(start, size)]
    last = np.cumsum(size) - 1
    out[last] = 0x20
    ends = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    sizes = np.bincount(doc, size, len(part.sizes)).astype(np.int64) - np.bincount(doc[ends], minlength=len(part.sizes))
    return text_array(np.delete(out, last[ends]), sizes, pa.string())


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a column of lists of whole numbers: sizes (0 for null) and all values."""
    column = column.cast(pa.large_list(pa.int64()))
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return sizes, np.asarray(column.flatten(), np.int64)


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true places, cut at ``bounds``: start, end, and in which stretch."""
    n = len(mask)
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1] | cut[1:n]
    ends[:-1] &= ~mask[1:] | cut[1:n]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(bounds, start, side="right") - 1
