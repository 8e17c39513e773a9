"""Substring dedup by difference-cover anchors.

A difference cover D of period v has, for any two places i and j, a shift s < v with both
(i + s) mod v and (j + s) mod v in D. So only stretches that begin at cover positions are
hashed: two equal windows, wherever they begin, share an anchor at one and the same shift.
Anchors whose stretch occurs once end there. The others are extended: an anchor whose whole
surroundings (all windows that can hold it) occur at another place as well settles its
windows at once; of the rest, the windows themselves are compared, one place standing for
each kind of surroundings. No pair of places is ever made.

Documents are rows: rows that share a doc_id and a text are one place, so a repeated row
is no copy of itself; rows without doc_id differ by their text. Null and empty texts have no
words. Documents shorter than a window lose nothing. Extra columns are ignored.
An empty table gives an empty result. A very long text is a slice of its own, at up to 70 bytes a byte."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .rolling import Spans, Words, byte_spans, covered, lists, mix, ranges, runs, slices, spaced, words
from .shared import all_with_marks, by_document, only_marked, places

WINDOW = 35
PERIOD = 21


def difference_cover(period: int) -> np.ndarray:
    """A smallest set that holds 0 and whose differences give every residue."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            if len({(a - b) % period for a in (0, *rest) for b in (0, *rest)}) == period:
                return np.array((0, *rest))
    raise ValueError("period must be positive")


class Shape:
    """Window and period, and what follows: the anchor's stretch and its reach."""

    def __init__(self, window: int, period: int):
        if not 0 < period <= window:
            raise ValueError("0 < period <= window")
        self.window, self.period = window, period
        self.reach, self.stretch = period - 1, window - period + 1
        self.cover = np.isin(np.arange(period), difference_cover(period))

    def around(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the windows that hold an anchor reach to its left, and right of its stretch."""
        return np.minimum(self.reach, at), np.minimum(self.reach, count - at - self.stretch)


def _word_spans(part, found: Words) -> Spans:
    return Spans(byte_spans(part.buf).hash(found.start, found.end))


def _anchors(shape: Shape, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = words(part)
            doc, count = found.doc, found.counts[found.doc]
            at = np.arange(len(doc)) - found.first[doc]
            use = np.flatnonzero(shape.cover[at % shape.period] & (at + shape.stretch <= count) & (count >= shape.window))
            spans = _word_spans(part, found)
            key = spans.hash(use, use + shape.stretch).view(np.int64)
            if not whole:
                yield pa.record_batch({"key": key})
                continue
            at, doc, count = at[use], doc[use], count[use]
            left, right = shape.around(at, count)
            around = spans.hash(use - left, use + shape.stretch + right) ^ mix((left * shape.window + right).astype(np.uint64))
            ids, tags = (np.asarray(part.rows.column(c)) for c in ("_doc", "_tag"))
            yield pa.record_batch({"key": key, "around": around.view(np.int64), "doc": ids[doc], "tag": tags[doc], "at": at})

    return run


def _windows(shape: Shape):
    """Each window that holds a marked anchor, once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = words(part)
            spans = _word_spans(part, found)
            other = Spans(mix(byte_spans(part.buf).hash(found.start, found.end) + np.uint64(1)))
            sizes, marks = lists(part.rows.column("_marks"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            left, right = shape.around(marks, found.counts[doc])
            first = found.first[doc] + marks - left
            number = np.maximum(0, left + shape.stretch + right - shape.window + 1)
            start = np.unique(ranges(first, number))
            doc = np.searchsorted(found.first, start, side="right") - 1
            ids, tags = (np.asarray(part.rows.column(c)) for c in ("_doc", "_tag"))
            yield pa.record_batch({
                "one": spans.hash(start, start + shape.window).view(np.int64),
                "two": (other.hash(start, start + shape.window) >> np.uint64(32)).astype(np.int32),
                "doc": ids[doc], "tag": tags[doc], "at": start - found.first[doc],
            })

    return run


def _removed(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = words(part)
            sizes, marks = lists(part.rows.column("_marks"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at, whole = marks >> 1, (marks & 1) == 1
            left, right = shape.around(at, found.counts[doc])
            start = found.first[doc] + at
            gone = covered(
                len(found.start), np.where(whole, start - left, start),
                np.where(whole, start + shape.stretch + right, start + shape.window),
            )
            lo, hi, doc = runs(gone, found.first)
            ends = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(np.bincount(doc, minlength=len(sizes)), out=ends[1:])
            spans = pa.StructArray.from_arrays([pa.array(lo - found.first[doc]), pa.array(hi - found.first[doc])], ["start", "end"])
            yield pa.record_batch({
                "doc_id": part.rows.column("doc_id"), "n_words": found.counts,
                "n_removed": np.bincount(found.doc, gone, len(sizes)).astype(np.int64),
                "spans": pa.ListArray.from_arrays(pa.array(ends), spans), "kept_text": spaced(part, found, ~gone),
            })

    return run


def repeated_marks(rows: DataFrame, shape: Shape) -> DataFrame:
    """Per row with repeated windows the places to remove: 2 * window start, or 2 * anchor + 1
    for all windows that hold the anchor."""
    twice = stage(rows.mapInArrow(_anchors(shape, False), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    anchors = rows.mapInArrow(_anchors(shape, True), "key long, around long, doc long, tag long, at long")
    anchors = stage(anchors.join(twice.hint("shuffle_merge"), "key", "left_semi"))
    place = F.struct("doc", "tag", "at")
    kinds = anchors.groupBy("key", "around").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    kinds = stage(kinds.select("key", "around", "lo.*", (F.col("lo") < F.col("hi")).alias("copied")))
    whole = anchors.join(kinds.where("copied").select("key", "around").hint("shuffle_merge"), ["key", "around"], "left_semi")

    several = kinds.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    edges = stage(by_document(kinds.join(several, "key", "left_semi"), F.col("at")))
    windows = stage(only_marked(rows, edges).mapInArrow(_windows(shape), "one long, two int, doc long, tag long, at long"))
    again = windows.groupBy("one", "two").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi")
    again = stage(again.select("one", "two"))
    single = windows.join(again.hint("shuffle_merge"), ["one", "two"], "left_semi")
    found = whole.select("doc", "tag", "at", F.lit(1).alias("whole")).unionByName(single.select("doc", "tag", "at", F.lit(0).alias("whole")))
    return stage(by_document(found, F.col("at") * 2 + F.col("whole")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """Remove each word covered by a window of ``window`` words whose sequence also starts at
    another place. Returns doc_id, n_words, n_removed, spans (word numbers, end exclusive),
    kept_text (words joined by one space) for every row."""
    shape = Shape(window, period)
    rows = places(docs)
    marked = all_with_marks(rows, repeated_marks(rows, shape))
    return marked.mapInArrow(
        _removed(shape), "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
    )
