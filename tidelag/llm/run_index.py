"""Substring dedup with a run-length index.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. The corpus is
parsed into overlapping phrases at content-defined anchors: the windows of ``length`` bytes
whose smallest gram stands at one place make up a phrase, and two equal windows always lie in
phrases with the same gram. So all windows that can match meet under one key, whatever
document they are in, and the parse is a dictionary of phrases with the places of each.

Only phrases whose gram occurs again are looked at. Equal phrases under a key are one entry of
the dictionary, indexed at its first and its last place; the places between are copies that
would only lengthen runs, and share the last one's answer. The entries are dealt into blocks, and
the keys of a block into parts. Each part builds a suffix order of its texts, those that are equal
once, and their Burrows-Wheeler transform as runs with the text places sampled at both ends of
every run, takes the match lengths at the run heads and streams them through the text: inside a
run the length falls by one per step. Neighbours in suffix order that match for ``length`` bytes
form a class, and all but its earliest window go.

Keys with more entries than a block holds are split by the windows' hash (128 bits) instead,
counted with partial sums, so no key has to fit in one task.

Null and empty texts have no bytes. Documents compare by (doc_id, place): rows that share a
doc_id and a text are one document, so neither is earlier and a repeated row is not removed;
rows without doc_id come first and differ by their text. Extra columns are ignored.
An empty table gives an empty result. Texts go in slices of 64 KB; a longer one is a slice of its own, at up to 70 bytes a byte."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .rolling import Slice, byte_spans, covered, lists, mix, ranges, runs, slices, text_array
from .shared import all_with_marks, by_document, only_marked, places

LENGTH = 100
GRAM = 39
#: Bytes of phrases per block of the index.
BLOCK_BYTES = 1 << 20
#: Bytes of text parsed, or indexed, at a time: the arrays stay in a core's cache.
PART_BYTES = 1 << 16
#: A key with more entries is split by window hash.
KEY_ENTRIES = 1 << 12
#: at = start << 8 | windows
START = 8


def _phrases(part: Slice, length: int, gram: int):
    """doc, start, windows, anchor of each phrase of a slice, the gram hashes, and the hashes of any span."""
    spans = byte_spans(part.buf)
    hashes = spans.windows(gram)
    place = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    width, reach = 1, length - gram + 1
    while width < reach:
        step = min(width, reach - width)
        place = np.minimum(place[:-step], place[step:]) if len(place) > step else place[:0]
        width += step
    number = np.maximum(0, part.sizes - length + 1)
    begins = np.zeros(len(place), bool)
    begins[1:] = place[1:] != place[:-1]
    begins[part.off[:-1][number > 0]] = True
    head = np.flatnonzero(begins)
    # places whose windows would cross the end of a document begin nothing
    doc = np.searchsorted(part.off, head, side="right") - 1
    last = part.off[doc] + number[doc]
    windows = np.minimum(np.append(head[1:], len(place)), last) - head
    whole = windows > 0
    head = head[whole]
    anchor = (place[head] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return doc[whole], head, windows[whole], anchor, hashes, spans


def _places(part, doc: np.ndarray, start: np.ndarray, windows) -> dict:
    ids, tags = (np.asarray(part.rows.column(c)) for c in ("_doc", "_tag"))
    return {"doc": ids[doc], "tag": tags[doc], "at": ((start - part.off[doc]) << START) + windows}


def _scan(length: int, gram: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PART_BYTES):
            doc, start, windows, anchor, hashes, spans = _phrases(part, length, gram)
            key = hashes[anchor].view(np.int64)
            if not whole:
                yield pa.record_batch({"key": key})
                continue
            around = spans.hash(start, start + windows + length - 1) ^ mix((anchor - start).astype(np.uint64))
            yield pa.record_batch({"key": key, "around": around.view(np.int64)} | _places(part, doc, start, windows))

    return run


def _marked(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start in the slice, low bits of every mark."""
    sizes, marks = lists(part.rows.column("_marks"))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return doc, (marks >> START) + part.off[doc], marks & ((1 << START) - 1)


def _texts(length: int, gram: int):
    """Key, place and bytes of the marked phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PART_BYTES):
            doc, start, windows = _marked(part)
            _, found_start, _, anchor, hashes, _ = _phrases(part, length, gram)
            key = hashes[anchor][np.searchsorted(found_start, start)].view(np.int64)
            size = windows + length - 1
            data = part.buf[ranges(start, size)]
            yield pa.record_batch({"key": key} | _places(part, doc, start, windows) | {"text": text_array(data, size, pa.binary())})

    return run


def _windows(length: int):
    """Both hashes and the place of every window of the marked phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PART_BYTES):
            doc, start, windows = _marked(part)
            begin, doc = ranges(start, windows), np.repeat(doc, windows)
            one = byte_spans(part.buf).hash(begin, begin + length)
            two = byte_spans(np.bitwise_xor(part.buf, 0x55)).hash(begin, begin + length)
            yield pa.record_batch({"one": one.view(np.int64), "two": two.view(np.int64)} | _places(part, doc, begin, 1))

    return run


@dataclass
class RunIndex:
    """Run-compressed transform of a text: the symbol and first row of each run, the text
    places of its first and last row, and how many symbols the heads share with the row before."""

    symbol: np.ndarray
    row: np.ndarray
    head: np.ndarray
    end: np.ndarray
    shared: np.ndarray

    @classmethod
    def build(cls, text: np.ndarray, order: np.ndarray, words: Packed) -> RunIndex:
        before = text[order - 1]
        row = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        end = order[np.append(row[1:], len(order)) - 1]
        head = order[row]
        return cls(before[row], row, head, end, np.append(0, words.common(head[1:], end[:-1])))

    def match_lengths(self, size: int) -> np.ndarray:
        """For each text place the symbols shared with the suffix ordered just before it:
        known at run heads, one less at each further place until the next head."""
        value = np.zeros(size, np.int64)
        value[self.head] = self.shared + self.head
        return np.maximum.accumulate(value) - np.arange(size)


@dataclass
class Packed:
    """The ``depth`` symbols from each place on as one number, zeros behind the end of its phrase.
    ``left``: symbols up to and with the phrase's separator."""

    value: np.ndarray
    left: np.ndarray
    bits: int
    depth: int

    @classmethod
    def pack(cls, symbols: np.ndarray, left: np.ndarray) -> Packed:
        bits = max(1, int(symbols.max()).bit_length())
        # a number is sorted with a place behind it, and has to be exact as a float
        depth = max(1, min(53, 63 - len(symbols).bit_length()) // bits)
        value, width = symbols.astype(np.int64), 1
        while width < depth:
            # the last ``step`` symbols of both halves may be the same ones
            step = min(width, depth - width)
            more = np.zeros_like(value)
            more[:-width] = value[width:] >> (width - step) * bits
            more[left <= width] = 0
            value = value << step * bits | more
            width += step
        return cls(value, left, bits, depth)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols of text the suffixes at a and b share."""
        most = np.minimum(self.left[a], self.left[b]) - 1
        same = np.zeros(len(a), np.int64)
        alive = np.flatnonzero(most > 0)
        at, to, step = a[alive], b[alive], 0
        while len(alive):
            other = self.value[at] ^ self.value[to]
            ends = np.flatnonzero(other)
            # a difference of k bits leaves the symbols above it equal
            high = np.frexp(other[ends].astype(np.float64))[1]
            same[alive[ends]] = step + self.depth - 1 - (high - 1) // self.bits
            step += self.depth
            go = other == 0
            same[alive[go]] = step
            go &= most[alive] > step
            alive, at, to = alive[go], at[go] + self.depth, to[go] + self.depth
        return np.minimum(same, most)


def suffix_order(words: Packed) -> np.ndarray:
    """Order of all suffixes up to the ends of their phrases, equal ones by place. Ranks of
    depth d give ranks of 2 d; only suffixes that are not yet alone are sorted again. Three
    numbers up to n share 63 bits; PART_BYTES and KEY_ENTRIES keep n below 2 ** 21."""
    n, depth = len(words.value), words.depth
    bits = n.bit_length()
    low = (1 << bits) - 1
    key = words.value << bits | np.arange(n)
    key.sort()
    order = key & low
    key >>= bits
    rows = np.arange(n)
    fresh = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int64)
    while True:
        # the rank of a group of equal suffixes is its first row
        group = np.maximum.accumulate(np.where(fresh, rows, 0))
        rank[order[rows]] = group
        # groups that end within this depth are equal to their ends
        tied = ~(fresh & np.append(fresh[1:], True)) & (words.left[order[rows]] > depth)
        rows, group = rows[tied], group[tied]
        if not len(rows):
            return order
        at = order[rows]
        key = (group << bits | rank[at + depth]) << bits | np.arange(len(rows))
        key.sort()
        order[rows] = at[key & low]
        key >>= bits
        fresh = np.append(True, key[1:] != key[:-1])
        depth *= 2


def later_windows(texts: list[bytes] | pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase number and offset of each window that also starts in an earlier phrase, or
    earlier in its own. Equal phrases are one text of the index."""
    coded = (pa.array(texts, pa.binary()) if isinstance(texts, list) else texts).dictionary_encode()
    number, kinds = np.asarray(coded.indices), coded.dictionary
    ends = np.frombuffer(kinds.buffers()[1], np.int32)[kinds.offset : kinds.offset + len(kinds) + 1].astype(np.int64)
    data = np.frombuffer(kinds.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    stop = np.cumsum(sizes + 1) - 1
    kind = np.repeat(np.arange(len(kinds)), sizes + 1)
    is_text = np.ones(len(kind), bool)
    is_text[stop] = False
    used = np.bincount(data, minlength=256) > 0
    symbols = np.zeros(len(kind), np.int64)
    symbols[is_text] = np.cumsum(used)[data]
    words = Packed.pack(symbols, stop[kind] - np.arange(len(kind)) + 1)
    order = suffix_order(words)
    distinct = np.where(is_text, symbols, 256 + kind)
    shared = RunIndex.build(distinct, order, words).match_lengths(len(kind))
    fresh = np.flatnonzero(shared[order] < length)
    first = np.repeat(np.minimum.reduceat(order, fresh), np.diff(np.append(fresh, len(order))))
    again = np.sort(order[order != first])
    # a kind's first phrase keeps the windows that are the first of their class; its other phrases keep none
    shown = np.zeros(len(kinds), np.int64)
    shown[number[::-1]] = np.arange(len(number))[::-1]
    copy = np.flatnonzero(shown[number] != np.arange(len(number)))
    windows = np.maximum(0, sizes[number[copy]] - length + 1)
    phrase = np.append(shown[kind[again]], np.repeat(copy, windows))
    offset = np.append(again - (stop - sizes)[kind[again]], ranges(np.zeros(len(copy), np.int64), windows))
    at = np.argsort(phrase, kind="stable")
    return phrase[at], offset[at]


def _index_block(length: int):
    def run(block: pa.Table) -> pa.Table:
        key, doc, tag, at = (np.asarray(block.column(c)) for c in ("key", "doc", "tag", "at"))
        # keys are independent of each other: parts of whole keys, each the text of one index
        size = np.asarray(pc.binary_length(block.column("text"))).astype(np.int64)
        rank = np.unique(key, return_inverse=True)[1]
        weight = np.bincount(rank, size)
        part = ((np.cumsum(weight) - weight) // PART_BYTES).astype(np.int64)[rank]
        order = np.lexsort((at, tag, doc, key, part))
        part, key, doc, tag, at = part[order], key[order], doc[order], tag[order], at[order]
        # a repeated row gives its phrases again, at the same place
        same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (at[1:] == at[:-1])
        once = np.append(True, ~same)
        texts = block.column("text").cast(pa.binary()).combine_chunks().take(pa.array(order[once]))
        part, doc, tag, at = part[once], doc[once], tag[once], at[once]
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [len(part)]
        spans = []
        for lo, hi in zip(edges, edges[1:]):
            place = np.lexsort((at[lo:hi], tag[lo:hi], doc[lo:hi]))
            phrase, offset = later_windows(texts.slice(lo, hi - lo).take(pa.array(place)), length)
            phrase = lo + place[phrase]
            spans.append(_joined(doc[phrase], tag[phrase], (at[phrase] >> START) + offset, length))
        return pa.table({c: np.concatenate([s[c] for s in spans]) for c in ("doc", "tag", "at")})

    return run


def _joined(doc: np.ndarray, tag: np.ndarray, begin: np.ndarray, length: int) -> dict:
    """Windows as spans of at most 255 bytes: consecutive ones are one span."""
    long = 255 - length + 1
    breaks = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (begin[1:] != begin[:-1] + 1)
    run_at = np.flatnonzero(np.append(True, breaks)) if len(begin) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(run_at, len(begin)))
    pieces = -(-sizes // long)
    piece = ranges(np.zeros(len(pieces), np.int64), pieces) * long
    first = np.repeat(run_at, pieces) + piece
    count = np.minimum(long, np.repeat(sizes, pieces) - piece)
    return {"doc": doc[first], "tag": tag[first], "at": (begin[first] << START) + count + length - 1}


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=PART_BYTES):
        doc, start, size = _marked(part)
        gone = covered(len(part.buf), start, start + size)
        lo, hi, doc = runs(gone, part.off)
        count = np.bincount(doc, minlength=len(part.sizes))
        spans = pa.StructArray.from_arrays([pa.array(lo - part.off[doc]), pa.array(hi - part.off[doc])], ["start", "end"])
        removed = np.bincount(doc, hi - lo, len(part.sizes)).astype(np.int64)
        yield pa.record_batch({
            "doc_id": part.rows.column("doc_id"), "n_bytes": part.sizes, "n_removed": removed, "n_spans": count,
            "spans": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), spans),
            "kept": text_array(part.buf[~gone], part.sizes - removed, pa.binary()),
        })


def _by_row(found: DataFrame) -> DataFrame:
    """Marks (start << 8 | low bits) of each row."""
    return by_document(found, F.col("at"))


def later_marks(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Per row the spans to remove, as start << 8 | bytes."""
    keys = rows.mapInArrow(_scan(length, gram, False), "key long")
    twice = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    found = rows.mapInArrow(_scan(length, gram, True), "key long, around long, doc long, tag long, at long")
    found = stage(found.join(twice.hint("shuffle_merge"), "key", "left_semi"))
    place = F.struct("doc", "tag", "at")
    entries = stage(found.groupBy("key", "around").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")))
    copied = entries.where("first < last AND n > 2").select("key", "around", "first", "last")
    copies = found.join(copied.hint("shuffle_merge"), ["key", "around"]).where((place > F.col("first")) & (place < F.col("last")))
    copies = copies.select("doc", "tag", (F.col("at") + (length - 1)).alias("at"))

    spots = F.when(F.col("first") < F.col("last"), F.array("first", "last")).otherwise(F.array("first"))
    entries = entries.select("key", F.explode(spots).alias("p")).select("key", "p.*")
    several = stage(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    entries = entries.join(several, "key")
    indexed, split = (_by_row(entries.where(c).select("doc", "tag", "at")) for c in (f"n <= {KEY_ENTRIES}", f"n > {KEY_ENTRIES}"))
    total = several.where(f"n <= {KEY_ENTRIES}").agg(F.sum("n")).first()[0] or 0
    blocks = max(1, total * (2 * length) // BLOCK_BYTES)
    texts = only_marked(rows, stage(indexed)).mapInArrow(_texts(length, gram), "key long, doc long, tag long, at long, text binary")
    texts = texts.withColumn("block", F.pmod(F.hash("key"), F.lit(blocks)))
    later = texts.groupBy("block").applyInArrow(_index_block(length), "doc long, tag long, at long")

    windows = stage(only_marked(rows, stage(split)).mapInArrow(_windows(length), "one long, two long, doc long, tag long, at long"))
    again = windows.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    hashed = windows.join(stage(again.select("one", "two", "first")).hint("shuffle_merge"), ["one", "two"])
    hashed = hashed.where(place > F.col("first")).select("doc", "tag", (F.col("at") + (length - 1)).alias("at"))
    return stage(_by_row(copies.unionByName(later).unionByName(hashed)))


def remove_later(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (byte places, end exclusive) and kept (the
    remaining bytes) for every row."""
    if not 0 < gram <= length <= 128:
        raise ValueError("0 < gram <= length <= 128")
    rows = places(docs)
    marked = all_with_marks(rows, later_marks(rows, length, gram))
    return marked.mapInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
    )
