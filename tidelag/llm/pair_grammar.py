"""Token ids in files, compressed by pair grammars.

Documents are put in order by a range partitioning on doc_id, encoded, and cut into shards of
about SHARD_TOKENS ids. In each shard frequent pairs of neighbouring symbols are replaced by
new symbols, round after round, until no pair is seen LEAST times; the pairs are the rules. A shard is a row of a Parquet file:
its rules with the number of ids each stands for, its symbols, and per document how many ids
and symbols it has. No pair spans two documents, so one document can be decoded alone, and the
lengths find any id without expanding what lies before it.

Null and empty texts have the end id alone. Rows without doc_id come first; rows that share
one are in the order of their texts' hashes. An empty table gives no shards. Extra columns are
ignored. Pairs replaced in one round are numbered by their
ids; of overlapping places every second one counts, from the left. A very long text is encoded in one call."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rolling import Slice, ranges, slices, text_array

END = 2
SHARD_TOKENS = 1 << 20
#: Pairs seen less often stay; each round takes all pairs down to a share of the best one.
LEAST, SHARE = 6, 16
KNOWN_WORDS = 3 << 18
#: So many new words are one text for the tokenizer.
TOGETHER = 1 << 8
#: Texts are encoded in slices of so many bytes.
TEXT_BYTES = 1 << 22
SHARDS = (
    "part int, seq int, n_tokens long, base int, doc_ids array<long>, tokens array<int>, symbols array<int>, "
    "left array<int>, right array<int>, lengths array<int>, body array<int>"
)


@dataclass
class Grammar:
    """``body``: symbols; symbol base + r stands for left[r], right[r], which are older."""

    base: int
    left: np.ndarray
    right: np.ndarray
    body: np.ndarray
    lengths: np.ndarray = field(init=False)

    def __post_init__(self):
        self.lengths = np.ones(len(self.left), np.int64)
        size = np.ones(self.base + len(self.left), np.int64)
        # rules of a round use symbols of earlier rounds only; sizes settle in as many passes
        while len(self.left):
            new = size[self.left] + size[self.right]
            if (new == size[self.base :]).all():
                break
            size[self.base :] = new
        self.lengths = size[self.base :]

    @property
    def sizes(self) -> np.ndarray:
        """Ids that each symbol of the body stands for."""
        rule = self.body >= self.base
        out = np.ones(len(self.body), np.int64)
        out[rule] = self.lengths[self.body[rule] - self.base]
        return out

    def expand(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids of body[start:end]."""
        out = self.body[start:end]
        if len(out) <= len(self.left):
            return self._unfold(out)
        # every rule once, and the symbols behind them
        rules = self._unfold(np.arange(self.base, self.base + len(self.left), dtype=out.dtype))
        rule = out >= self.base
        at, count = np.arange(len(rules), len(rules) + len(out)), np.ones(len(out), np.int64)
        which = out[rule] - self.base
        at[rule], count[rule] = (np.cumsum(self.lengths) - self.lengths)[which], self.lengths[which]
        return np.append(rules, out)[ranges(at, count)]

    def _unfold(self, out: np.ndarray) -> np.ndarray:
        while True:
            rule = out >= self.base
            if not rule.any():
                return out
            at = np.cumsum(1 + rule) - 1 - rule
            new = np.empty(len(out) + int(rule.sum()), out.dtype)
            new[at[~rule]] = out[~rule]
            new[at[rule]] = self.left[out[rule] - self.base]
            new[at[rule] + 1] = self.right[out[rule] - self.base]
            out = new

    def at(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start``, expanding only the symbols that hold them."""
        stop = np.cumsum(self.sizes)
        first = int(np.searchsorted(stop, start, side="right"))
        last = int(np.searchsorted(stop, start + count - 1, side="right"))
        skip = start - (int(stop[first - 1]) if first else 0)
        return self.expand(first, last + 1)[skip : skip + count]


def _sorted_pairs(key: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and their places; ``bits``: what places need."""
    if int(key.max(initial=0)).bit_length() + bits > 63:
        order = np.argsort(key, kind="stable")
        return key[order], place[order].astype(np.int32)
    key = key << bits | place
    key.sort()
    return key >> bits, (key & ((1 << bits) - 1)).astype(np.int32)


def compress(ids: np.ndarray, doc: np.ndarray) -> tuple[Grammar, np.ndarray]:
    """Grammar of ``ids``, and the document of each symbol of its body.

    A pair of old symbols never gets more places, so a round counts only the pairs that the last one's
    new symbols made; of those seen LEAST times the places are listed, and their number kept up to date."""
    n = len(ids)
    base = int(ids.max()) + 1 if n else 1
    # symbols stay where they begin; n: nothing comes before or after in the document
    body = np.append(ids, -1).astype(np.int32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    inner = doc[1:] == doc[:-1]
    edge = np.flatnonzero(~inner)
    after[edge] = after[-2:] = before[edge + 1] = before[0] = n
    place_bits, bits = n.bit_length(), (base + n // 2).bit_length()
    key, new = (body[:-2].astype(np.int64) << bits | body[1:-1])[inner], np.flatnonzero(inner)
    # of each listed pair how many places it has, how many it had, and where these stand in spots
    pairs, counts, sizes, starts = (np.zeros(0, np.int64) for _ in range(4))
    # a place is new at the start and twice for each replaced one, of which there are fewer than n
    spots, filled, listed = np.empty(3 * n, np.int32), 0, np.full(n + 1, -1, np.int32)
    left, right, size = [], [], base
    while True:
        key, new = _sorted_pairs(key, new, place_bits)
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        count = np.diff(np.append(head, len(key)))
        often = count >= LEAST
        held, count = new[np.repeat(often, count)], count[often]
        listed[held] = np.repeat(np.arange(len(pairs), len(pairs) + len(count), dtype=np.int32), count)
        pairs, starts = np.append(pairs, key[head[often]]), np.append(starts, filled + np.cumsum(count) - count)
        counts, sizes = np.append(counts, count), np.append(sizes, count)
        spots[filled : filled + len(held)] = held
        filled += len(held)
        best = int(counts.max(initial=0))
        if best < LEAST:
            break
        chosen = np.flatnonzero(counts >= max(LEAST, best // SHARE))
        chosen = chosen[np.argsort(pairs[chosen])]
        place, which = spots[ranges(starts[chosen], sizes[chosen])], np.repeat(np.arange(len(chosen)), sizes[chosen])
        still = listed[place] == np.repeat(chosen.astype(np.int32), sizes[chosen])
        place, which = _sorted_pairs(place[still].astype(np.int64), which[still], len(chosen).bit_length())
        # of pairs that overlap, every second one from the left
        linked = np.flatnonzero(after[place[:-1]] == place[1:]) + 1
        run = np.flatnonzero(np.append(True, linked[1:] != linked[:-1] + 1)[: len(linked)])
        even = (np.arange(len(linked)) - np.repeat(run, np.diff(np.append(run, len(linked))))) & 1 == 0
        odd = np.zeros(len(place), bool)
        odd[linked[even]] = True
        place, which = place[~odd], which[~odd]
        # half of the places or more are left, LEAST / 2 a pair on average; pairs with one wait
        used = np.bincount(which, minlength=len(chosen)) > 1
        place, which = place[used[which]], (np.cumsum(used) - 1)[which[used[which]]]
        rules = pairs[chosen[used]]
        left.append(rules >> bits)
        right.append(rules & ((1 << bits) - 1))
        second = after[place]
        rest = after[second]
        body[place], body[second] = size + which, -1
        after[place], before[rest] = rest, place
        prior = before[place]
        prior = prior[(prior < n) & (body[prior] < size)]
        listed[place] = -1
        counts[chosen[used]] -= np.bincount(which, minlength=len(rules))
        for gone in (second, prior):
            lost = listed[gone]
            counts -= np.bincount(lost[lost >= 0], minlength=len(counts))
            listed[gone] = -1
        new = np.concatenate([place[rest < n], prior])
        key = body[new].astype(np.int64) << bits | body[after[new]]
        size += len(rules)
    none = np.zeros(0, np.int32)
    kept = np.flatnonzero(body[:n] >= 0)
    grammar = Grammar(base, *(np.concatenate(x).astype(np.int32) if x else none for x in (left, right)), body[kept])
    return grammar, doc[kept].astype(np.int32)


#: What a byte is: a separator, a letter, a digit, other ASCII, or one that only the library can judge
#: (beyond ASCII, control characters, apostrophes of contractions, bars of special tokens).
BREAK, LETTER, DIGIT, OTHER, OPEN = range(5)
_kinds = bytearray([OPEN]) * 256
_kinds[0x21:0x7F] = bytes([OTHER]) * 0x5E
for _kind, _characters in ((BREAK, b" \n"), (LETTER, bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))), (DIGIT, b"0123456789"), (OPEN, b"'|")):
    for _character in _characters:
        _kinds[_character] = _kind


def _units(part: Slice) -> tuple[pa.Array, np.ndarray]:
    """The units of a slice, which the tokenizer encodes alone, and each document's first one, and the end.
    It parts words at spaces and line feeds, letters, digits and other characters from each other, and
    digits; it lower-cases, which is left to it in units that hold a byte of kind OPEN."""
    n = len(part.buf)
    text = part.buf.tobytes()
    kind = np.frombuffer(text.translate(_kinds), np.uint8)
    solid = kind != BREAK
    begins = solid.copy()
    begins[1:] &= (kind[1:] != kind[:-1]) & (kind[1:] != OPEN) & (kind[:-1] != OPEN) | (kind[1:] == DIGIT) & (kind[:-1] == DIGIT) | ~solid[:-1]
    edge = part.off[:-1][part.sizes > 0]
    begins[edge] = solid[edge]
    start = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= begins[1:] | ~solid[1:]
    size = np.flatnonzero(ends) + 1 - start
    data = np.frombuffer(bytearray(text).lower(), np.uint8)
    opened = np.zeros(len(start), bool)
    opened[np.searchsorted(start, np.flatnonzero(kind == OPEN), side="right") - 1] = True
    same = ranges(start[opened], size[opened])
    data[same] = part.buf[same]
    return text_array(data[solid], size, pa.binary()), np.searchsorted(start, part.off)


class Encoder:
    """Ids of texts by the tokenizer in a file, looked up by unit. Units not seen yet are
    encoded together, and kept until there are KNOWN_WORDS, by when the common ones are among them.
    Unit 0 stands for the end of a document."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, int] = {}
        self.ids, self.bounds, self.size = np.full(1, end, np.int32), np.array([0, 1]), 1

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _look_up(self, new: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The units' numbers in some order, all ids in that order, and how many each unit has."""
        words, alone = [], []
        for k, w in enumerate(new):
            (words if w.isalpha() else alone).append(k)
        order, ids, counts = [], [], []
        parts = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for part, found in zip(parts, self._batch([" ".join([new[k] for k in p]) for p in parts])):
            found = np.array(found, np.int32)
            # the last id of a word of letters closes it, no other does
            stops = np.flatnonzero(self.closes[found]) + 1
            if len(stops) == len(part) and stops[-1] == len(found):
                order += part
                ids.append(found)
                counts.append(np.diff(stops, prepend=0))
            else:
                alone += part
        rest = self._batch([new[k] for k in alone])
        ids.append(np.array(list(chain.from_iterable(rest)), np.int32))
        counts.append(np.array([len(x) for x in rest], np.int64))
        return order + alone, np.concatenate(ids), np.concatenate(counts)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Append, in room that doubles."""
        used, have = int(self.bounds[self.size]), self.size
        if used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(used + len(ids), np.int32))
        if have + len(counts) >= len(self.bounds):
            self.bounds = np.append(self.bounds, np.zeros(have + len(counts), np.int64))
        self.ids[used : used + len(ids)] = ids
        self.bounds[have + 1 : have + 1 + len(counts)] = used + np.cumsum(counts)
        self.size += len(counts)

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice, each with the end id, and how many each has."""
        units, first = _units(part)
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new, kept = np.flatnonzero(number < 0), self.size
        if len(new):
            words = [distinct[k] for k in new.tolist()]
            order, ids, counts = self._look_up([w.decode() for w in words])
            self._keep(ids, counts)
            number[new[order]] = np.arange(kept, self.size)
            if self.size <= KNOWN_WORDS:
                self.known.update(zip(words, number[new].tolist()))
            else:
                self.size = kept
        number = number[coded.indices.to_numpy()]
        number = np.insert(number, first[1:], 0)
        start = self.bounds[number]
        counts = self.bounds[number + 1] - start
        stop = np.cumsum(counts)[first[1:] + np.arange(len(part.sizes))]
        return self.ids[ranges(start, counts)], np.diff(stop, prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str, end: int) -> Encoder:
    """One per worker process, for all its tasks."""
    return Encoder(path, end)


def _shards(path: str, end: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        # ids, sizes and doc_ids of the documents that are in no shard yet
        open_: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ids, tokens = (np.concatenate([x[k] for x in open_]) for k in (0, 1))
            docs = pa.concat_arrays([x[2] for x in open_])
            grammar, doc = compress(ids, np.repeat(np.arange(len(tokens)), tokens))
            symbols = np.bincount(doc, minlength=len(tokens))
            columns = {"part": [part], "seq": [seq], "n_tokens": [int(tokens.sum())], "base": [grammar.base], "doc_ids": [docs.to_pylist()], "tokens": [tokens], "symbols": [symbols]}
            columns |= {"left": [grammar.left], "right": [grammar.right], "lengths": [grammar.lengths], "body": [grammar.body]}
            kinds = {"part": pa.int32(), "seq": pa.int32(), "n_tokens": pa.int64(), "base": pa.int32(), "doc_ids": pa.list_(pa.int64())}
            return pa.record_batch({k: pa.array(v, kinds.get(k, pa.list_(pa.int32()))) for k, v in columns.items()})

        for piece in slices(batches, limit=TEXT_BYTES):
            ids, tokens = encoder(path, end).encode(piece)
            docs, stop, at = piece.rows.column("doc_id"), np.cumsum(tokens), 0
            while at < len(tokens):
                gone = int(stop[at - 1]) if at else 0
                # the document that fills the shard is its last one
                to = min(len(tokens), int(np.searchsorted(stop, gone + shard_tokens - size)) + 1)
                open_.append((ids[gone : stop[to - 1]], tokens[at:to], docs.slice(at, to - at)))
                size += int(stop[to - 1]) - gone
                if size >= shard_tokens:
                    yield shard()
                    open_, size, seq = [], 0, seq + 1
                at = to
        if open_:
            yield shard()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text, append ``end``, and write shards in ascending order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("_text"))
    rows.mapInArrow(_shards(tokenizer, end, shard_tokens), SHARDS).write.option("compression", "zstd").parquet(path)


def read_shard(batch: pa.RecordBatch, row: int) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Grammar, and ids and symbols of each document."""
    left, right, body, tokens, symbols = (
        batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in ("left", "right", "body", "tokens", "symbols")
    )
    return Grammar(batch.column("base")[row].as_py(), left, right, body), tokens, symbols


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            grammar, tokens, _ = read_shard(batch, row)
            data = memoryview(grammar.expand().astype("<u4")).cast("B")
            stop = np.cumsum(tokens, dtype=np.int64)
            start = stop - tokens
            sums = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(start.tolist(), stop.tolist())]
            yield pa.record_batch({
                "part": np.full(len(tokens), batch.column("part")[row].as_py(), np.int32),
                "seq": np.full(len(tokens), batch.column("seq")[row].as_py(), np.int32),
                "doc_id": batch.column("doc_ids")[row].values, "within": start, "n_tokens": tokens.astype(np.int64),
                "ids_crc32": np.array(sums, np.int64),
            })


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            grammar, tokens, _ = read_shard(batch, row)
            bounds = pa.array(np.append(0, np.cumsum(tokens)).astype(np.int32))
            yield pa.record_batch({"doc_id": batch.column("doc_ids")[row].values, "ids": pa.ListArray.from_arrays(bounds, pa.array(grammar.expand()))})


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of every document in the files."""
    return spark.read.parquet(path).mapInArrow(_tokens, "doc_id long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # running sums in two steps: over the shards of a file part, and over the parts
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seq_start")).join(parts, "part")
    found = shards.mapInArrow(_documents, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    start = F.col("part_start") + F.col("seq_start") + F.col("within")
    return found.join(starts, ["part", "seq"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
