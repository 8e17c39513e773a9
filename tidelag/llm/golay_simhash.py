"""SimHash near-duplicates, linked by Golay-code fuzzy keys.

Every word of 23 bits lies within 3 bits of exactly one word of the Golay code. Its keys are
the indices (12 bits) of that codeword and, if it is 3 bits away, of the five at 4 bits: two
words that differ in at most one bit always share a key. A fingerprint of 64 bits is cut into
segments of 21, 21 and 22 bits. Up to 3 differing bits leave either one segment equal and
another with at most one error, or one error in each. So its keys are: each segment as it is
with each fuzzy key of each other one; and of the first two segments one half each as it is
with the fuzzy keys of the third. All have 33 bits or more, so chance meetings are rare.

Equal fingerprints are one; those that meet under a key are compared, and per key only links
that join parts not yet joined are kept, never all pairs. Links become components.

Rows of equal text have equal fingerprints and so one component, repeated rows included. Texts
without words (null, empty, blank) have fingerprint zero. Rows without doc_id get a component
through the others; component_id is null where no member has a doc_id. Extra columns are ignored.
An empty table gives an empty result. A very long text is a slice of its own, at up to 70 bytes a byte."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .components import components
from .rolling import Slice, ranges, slices, words
from .shared import small_side

SHINGLE = 3
SEED = 42
MOST = 3
#: Generator polynomial of the Golay code of length 23; the check bits are the low 11.
GENERATOR, CHECK_BITS, LENGTH = 0xC75, 11, 23
#: First bit and width of the segments, and of the halves of the first two.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
HALVES = (((0, 10), (10, 11)), ((21, 10), (31, 11)))
#: Under keys with this many members or fewer every link is kept.
FEW = 8


def _fingerprints(shingle: int, hashed: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            buf = np.where((part.buf >= 65) & (part.buf <= 90), part.buf + 32, part.buf).astype(np.uint8)
            part = Slice(part.rows, buf, part.off)
            found = words(part)
            size = found.end - found.start + 1
            flat = np.append(buf, np.uint8(0x20))[ranges(found.start, size)]
            end = np.cumsum(size) - 1
            flat[end] = 0x20
            begin, data, counts = end - size + 1, flat.tobytes(), found.counts
            number = np.where(counts > 0, np.maximum(1, counts - shingle + 1), 0)
            first = ranges(found.first[:-1], number)
            last = first + np.repeat(np.minimum(counts, shingle), number) - 1
            cut = zip(begin[first].tolist(), end[last].tolist())
            hashes = np.fromiter((xxhash.xxh64_intdigest(data[s:e], SEED) for s, e in cut), np.uint64, len(first))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
            full = np.flatnonzero(number)
            prints = np.zeros(len(number), np.uint64)
            if len(full):
                set_bits = np.add.reduceat(bits, (np.cumsum(number) - number)[full], axis=0, dtype=np.int32)
                over = np.packbits(2 * set_bits > number[full, None], axis=1)
                prints[full] = np.ascontiguousarray(over).view(np.uint64)[:, 0]
            out = {"doc_id": part.rows.column("doc_id").cast(pa.int64()), "fp": pa.array(prints.view(np.int64))}
            yield pa.record_batch(out | ({"hash": part.rows.column("hash")} if hashed else {}))

    return run


@lru_cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the single bits; per remainder the error patterns to codewords that count
    (all of weight up to 3, and of weight 4 if there is none below 3), 0 where there are fewer."""

    def remainder(word: int) -> int:
        while word >> CHECK_BITS:
            word ^= GENERATOR << (word.bit_length() - 1 - CHECK_BITS)
        return word

    single = np.array([remainder(1 << i) for i in range(LENGTH)])
    errors: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    weight = [LENGTH] * (1 << CHECK_BITS)
    for w in range(5):
        for at in combinations(range(LENGTH), w):
            s = int(np.bitwise_xor.reduce(single[list(at)])) if at else 0
            weight[s] = min(weight[s], w)
            if w <= 3 or weight[s] == 3:
                errors[s].append(sum(1 << i for i in at))
    table = np.full((1 << CHECK_BITS, 6), -1)
    for s, found in enumerate(errors):
        table[s, : len(found)] = found
    return single, table


def codeword_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of words of up to 23 bits, six places each, and which places count."""
    single, table = _golay()
    s = np.zeros(len(word), np.int64)
    for i in range(LENGTH):
        s ^= (word >> i & 1) * single[i]
    errors = table[s]
    return (word[:, None] ^ errors) >> CHECK_BITS, errors >= 0


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and which fingerprint each belongs to."""
    part = lambda at, width: (prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
    fuzzy = [codeword_keys(part(*s)) for s in SEGMENTS]
    plain = [(part(*SEGMENTS[a]), b) for a in range(3) for b in range(3) if a != b]
    plain += [(part(*x) << 11 | part(*y), 2) for x in HALVES[0] for y in HALVES[1]]
    keys, owner = [], []
    for table, (exact, b) in enumerate(plain):
        index, counts = fuzzy[b]
        keys.append(((table << 36) | exact[:, None] << 12 | index)[counts])
        owner.append(np.repeat(np.arange(len(prints)), counts.sum(axis=1)))
    return np.concatenate(keys), np.concatenate(owner)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.asarray(batch.column("fp"))
        key, owner = fuzzy_keys(prints.view(np.uint64))
        for at in range(0, len(key), 1 << 18):
            yield pa.record_batch({"key": key[at : at + (1 << 18)], "fp": prints[owner[at : at + (1 << 18)]]})


def _joining_links(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints as all links of up to ``most`` bits would: each one
    reached takes what is near it out of the rest."""
    rest, a, b = np.arange(len(prints)), [], []
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= most
            a.append(np.full(int(near.sum()), at))
            b.append(rest[near])
            reached.extend(rest[near].tolist())
            rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links_by_key(key: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked fingerprints that meet under a key; ``key`` is sorted."""
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(key)))
    few = np.repeat(size <= FEW, size)
    a, b = [], []
    for step in range(1, FEW):
        i = np.flatnonzero(few[:-step] & (key[step:] == key[:-step]))
        i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= most]
        a.append(i)
        b.append(i + step)
    for h, n in zip(head[size > FEW].tolist(), size[size > FEW].tolist()):
        x, y = _joining_links(prints[h : h + n], most)
        a.append(x + h)
        b.append(y + h)
    return np.concatenate(a), np.concatenate(b)


def _links(most: int):
    """Over rows sorted by key; the last key of a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(n: int) -> pa.RecordBatch:
            a, b = links_by_key(key[:n], prints[:n].view(np.uint64), most)
            x, y = prints[a], prints[b]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            return pa.record_batch({"a": np.ascontiguousarray(pairs[:, 0]), "b": np.ascontiguousarray(pairs[:, 1])})

        for batch in batches:
            key = np.append(key, np.asarray(batch.column("key")))
            prints = np.append(prints, np.asarray(batch.column("fp")))
            if len(key):
                whole = int(np.searchsorted(key, key[-1]))
                yield found(whole)
                key, prints = key[whole:], prints[whole:]
        yield found(len(key))

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _roots(rows: DataFrame, most: int) -> DataFrame:
    """fp, first (smallest doc_id), root for each different fingerprint of ``rows``, a written table."""
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long").repartition("key").sortWithinPartitions("key")
    roots = components(keys.mapInArrow(_links(most), "a long, b long"))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id among the rows that links of
    ``most`` or fewer differing bits lead to."""
    _check(most)
    rows = stage(fingerprints(docs, shingle))
    member = _roots(rows, most)
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(member.join(least, "root").select("fp", "component_id"))
    return rows.join(named.hint("shuffle_merge"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """Of each component one row: that of the smallest doc_id, rows without one last, and of rows
    that share it the one of least text hash. Columns as they were, whatever their names."""
    _check(most)
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("hash"))
    rows = stage(named.mapInArrow(_fingerprints(shingle, True), "doc_id long, fp long, hash long"))
    member = _roots(rows, most).select("fp", "root")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("best")
    best = stage(rows.join(stage(member).hint("shuffle_merge"), "fp").groupBy("root").agg(best).select("best.doc_id", "best.hash"))
    held = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("mark"))
    same = (F.col("mark") == F.col("hash")) & F.col("id").eqNullSafe(F.col("doc_id"))
    kept = held.join(small_side(best, 32), same, "left_semi").dropDuplicates(["id", "mark"])
    return kept.select("row.*")


def _check(most: int) -> None:
    if not 0 <= most <= MOST:
        raise ValueError(f"0 <= most <= {MOST}")
