"""Fill-in-middle transformation: units of a text found and selected eight bytes at a time.

A text is cut into units, words with the white space before them and white space at the end
(``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``). Its UTF-8 bytes are viewed as
64-bit numbers. Arithmetic on whole numbers marks the bytes that end a unit; the marks of each
number are counted, a search in the running counts finds the number that holds the end of the
k-th unit, and clearing lowest marks selects the byte in it. Code points of a stretch are
counted by the same marks. Two cuts, drawn from the hash of (seed, doc_id), give prefix, middle
and suffix.

A null or empty text has no units and stays plain, as does a text that holds a marker itself;
white space alone is one unit. Cuts are a function of doc_id, so repeated rows get equal
results; rows without doc_id are hashed as if it were empty. An empty table gives an empty
result. Extra columns are ignored. Texts are handled in slices of SLICE_BYTES, a longer text
as a slice of its own, which takes about six times its bytes while it is cut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import slices

SEED, RATE, SUFFIX_FIRST = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_every = lambda byte: np.uint64(byte * 0x0101010101010101)
HIGH, LOW7 = _every(0x80), _every(0x7F)
ONE, SEVEN, EIGHT = np.uint64(1), np.uint64(7), np.uint64(8)


def space_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is \\x20 or \\x09-\\x0D. No sum carries over to the next
    byte, since all are taken of seven bits."""
    low = words & LOW7
    blank = ~((low ^ _every(0x20)) + LOW7)
    control = (low + _every(0x80 - 0x09)) & ~(low + _every(0x80 - 0x0E))
    return (blank | control) & ~words & HIGH


def point_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point, any but 10xxxxxx."""
    return ~(words & ~(words << ONE)) & HIGH


class Units:
    """The unit ends of several texts, each padded by white space to whole 64-bit numbers."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.size = np.diff(off)
        held = (self.size + 8) // 8
        self.first = np.append(0, np.cumsum(held))
        padded = np.full(int(self.first[-1]) * 8, 0x20, np.uint8)
        for start, end, to in zip(off[:-1].tolist(), off[1:].tolist(), (self.first[:-1] * 8).tolist()):
            padded[to : to + end - start] = buf[start:end]
        words = padded.view(np.uint64)
        space = space_marks(words)
        following = np.append(space[1:], HIGH) << np.uint64(56)
        self.ends = ~space & HIGH & (space >> EIGHT | following)
        # white space at the end of a text is a unit, which its last byte ends
        full = np.flatnonzero(self.size)
        last = self.size[full] - 1
        self.ends[self.first[full] + last // 8] |= np.uint64(0x80) << (last % 8 * 8).astype(np.uint64)
        self.points = point_marks(words)
        self.ends_upto = self._running(self.ends)
        self.points_upto = self._running(self.points)

    @staticmethod
    def _running(marks: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(np.bitwise_count(marks), dtype=np.int64))

    @property
    def counts(self) -> np.ndarray:
        return self.ends_upto[self.first[1:]] - self.ends_upto[self.first[:-1]]

    def end_of(self, number: np.ndarray) -> np.ndarray:
        """For each text the place after its ``number``-th unit, 0 for number 0."""
        rank = self.ends_upto[self.first[:-1]] + number
        at = np.maximum(np.searchsorted(self.ends_upto, rank) - 1, 0)
        left = np.where(number > 0, rank - self.ends_upto[at], 0)
        marks = self.ends[np.minimum(at, len(self.ends) - 1)] if len(self.ends) else np.zeros(len(at), np.uint64)
        for passed in range(1, 8):
            marks = np.where(left > passed, marks & (marks - ONE), marks)
        byte = np.bitwise_count((marks & (~marks + ONE)) - ONE) >> 3
        return np.where(number > 0, (at - self.first[:-1]) * 8 + byte + 1, 0)

    def points_before(self, place: np.ndarray) -> np.ndarray:
        """For each text how many code points begin before byte ``place``."""
        at = self.first[:-1] + place // 8
        part = self.points[at] & ((ONE << (place % 8 * 8).astype(np.uint64)) - ONE)
        return self.points_upto[at] + np.bitwise_count(part) - self.points_upto[self.first[:-1]]


def _cut(markers: tuple[str, str, str]):
    p, s, m = (x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            units = Units(part.buf, part.off)
            n = units.counts
            one, two = (part.rows.column(c).to_numpy() % (n + 1) for c in ("h1", "h2"))
            low, high = units.end_of(np.minimum(one, two)), units.end_of(np.maximum(one, two))
            before, upto = units.points_before(low), units.points_before(high)
            forms, data, out = part.rows.column("form").to_pylist(), part.buf.tobytes(), []
            for form, start, a, b, end in zip(forms, part.off[:-1].tolist(), low.tolist(), high.tolist(), part.off[1:].tolist()):
                prefix, middle, suffix = data[start : start + a], data[start + a : start + b], data[start + b : end]
                if form == "plain":
                    out.append(data[start:end])
                elif form == "psm":
                    out.append(b"".join((p, prefix, s, suffix, m, middle)))
                else:
                    out.append(b"".join((s, suffix, p, prefix, m, middle)))
            plain = np.array([form == "plain" for form in forms])
            yield pa.record_batch({
                "doc_id": part.rows.column("doc_id"), "n": pa.array(n), "form": part.rows.column("form"),
                "prefix_chars": pa.array(before, mask=plain), "middle_chars": pa.array(upto - before, mask=plain),
                "output": pa.array(out, pa.binary()).cast(pa.string()),
            })

    return run


def _drawn(seed: int, group: int) -> Column:
    """The ``group``-th 8 digits, from 1, of the hash of (seed, doc_id), as a number."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * group - 7, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
    markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output of every
    row. ``rate`` per cent of the texts are rearranged: ``suffix_first`` per cent of these to
    form spm (suffix, prefix, middle), the others to psm (prefix, suffix, middle), each part
    after its marker (of prefix, suffix, middle)."""
    text = F.col("_text")
    held = [F.contains(text, F.lit(m)) for m in markers]
    plain = (text == "") | held[0] | held[1] | held[2] | (_drawn(seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_drawn(seed, 4) % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select("doc_id", "_text", _drawn(seed, 1).alias("h1"), _drawn(seed, 2).alias("h2"), form.alias("form"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_cut(markers), schema)


def restored(form: Column, output: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that was rearranged to ``output``. A marker never arises where a part meets a
    marker, since none of them begins inside another."""
    parts = F.split(output, "|".join(re.escape(m) for m in markers))
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
