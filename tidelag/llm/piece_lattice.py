"""SentencePiece encoding and decoding by a batched Viterbi search.

The search goes over the words of a text, cut where a space begins, and before and after each
character that only stands alone in pieces; no piece spans such a cut.
Words advance together, sorted by length: for every end place and piece length the hashes of all
words' substrings are looked up among the sorted hashes of the pieces. A pair model merges
pieces in a fixed order, so among all ways to cut a prefix exactly one can come out: the one
in which every two neighbours would also come out if encoded alone. That is what the search
scores: a step is open if its piece follows the best last piece of the prefix before it, and
the maximum over the open steps is stored as the backpointer. Ids equal the library's.

Characters without a piece become their UTF-8 bytes' pieces. Null and empty texts have no ids.
Decoding gives the text back, with U+2581 as a space. Rows are independent, so repeated rows
get equal ids. Extra columns are ignored. An empty table gives an empty result. A very
long text is a slice of its own; of words over 32 characters each is searched alone."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import ranges, slices

SPACE = "▁"
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
FIRST, NONE, UNKNOWN = -3, -2, -1
#: Words longer than this go one by one; words of so many characters, filled up, go together.
LONG, TOGETHER = 32, 1 << 17
#: Bytes of words whose ids a task keeps, and what one takes beside its text and its ids.
KNOWN_BYTES, WORD_BYTES = 16 << 20, 200
#: Bits of the table that says which hashes may be a piece's, and of the one of pairs decided before.
MAYBE_BITS, PAIR_BITS = 22, 18
TEXT_BYTES = 1 << 21


class Pieces:
    """Tables of a pair model: pieces that can come out, what they were merged from and when,
    and which pairs merge. Built once on the driver; a few MB for 32,000 pieces."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.text = [lib.id_to_piece(i) for i in range(size)]
        self.bytes_at = lib.piece_to_id("<0x00>")
        if not lib.is_byte(self.bytes_at):
            raise ValueError("the model has no pieces for bytes")
        number = {self.text[i]: i for i in plain}
        if any(SPACE in self.text[i].lstrip(SPACE) for i in plain):
            raise ValueError("the model has pieces that span words")
        # merge order: better scores first; single characters are there from the start
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain if len(self.text[i]) > 1}, reverse=True), 1)}
        self.rank = np.zeros(size + 1, np.int64)
        for i in plain:
            if len(self.text[i]) > 1:
                self.rank[i] = order[lib.get_score(i)]
        pairs = [
            (number[t[:c]], number[t[c:]], i) for i in plain for t in (self.text[i],) for c in range(1, len(t)) if t[:c] in number and t[c:] in number
        ]
        self.merges = {(a, b): i for a, b, i in pairs}
        self.left, self.right = np.arange(size + 1), np.arange(size + 1)
        keys = np.array([a * size + b for a, b, _ in pairs] or [0], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_piece = keys[by], np.array([i for *_, i in pairs] or [0])[by]
        able = []
        for i in plain:
            parts = self._merge(self.text[i], number)
            if parts[-1] == (i,):
                able.append(i)
                if len(parts) > 1:
                    self.left[i], self.right[i] = parts[-2]
        joined = re.escape("".join(sorted({c for i in able if len(self.text[i]) > 1 for c in self.text[i]} - {SPACE}))) or SPACE
        self.units = re.compile(f"{SPACE}*[{joined}]+|{SPACE}+|[^{joined}]", re.DOTALL)
        self.longest = max(len(self.text[i]) for i in able)
        self.able = {self.text[i]: i for i in able}
        hashes = np.array([string_hash(self.text[i]) for i in able], np.uint64)
        by = np.argsort(hashes)
        self.keys, self.piece = hashes[by], np.array(able)[by]
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - MAYBE_BITS)] = True
        self.size = size
        self.out = [self.text[i].replace(SPACE, " ").encode() for i in range(size)]
        for b in range(256):
            self.out[self.bytes_at + b] = bytes([b])
        for i in range(size):
            if lib.is_control(i):
                self.out[i] = b""
        self.out_bytes = np.frombuffer(b"".join(self.out), np.uint8)
        self.out_size = np.array([len(x) for x in self.out])
        self.out_start = np.cumsum(self.out_size) - self.out_size

    def _merge(self, text: str, number: dict[str, int]) -> list[tuple[int, ...]]:
        """The states that merging goes through."""
        if any(c not in number for c in text):
            return [()]
        state = [number[c] for c in text]
        states = [tuple(state)]
        while True:
            open_ = [(self.rank[self.merges[p]], k) for k, p in enumerate(zip(state, state[1:])) if p in self.merges]
            if not open_:
                return states
            _, k = min(open_)
            state[k : k + 2] = [self.merges[state[k], state[k + 1]]]
            states.append(tuple(state))

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a, b come out of their joined text as they are: undo the merges at
        the seam, latest first, and see whether the two sides would have merged before."""
        a, b = a.copy(), b.copy()
        result = (a != NONE) & (b != NONE)
        at = np.flatnonzero(result & (a >= 0) & (b >= 0))
        a, b = a[at], b[at]
        limit = np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            key = a * self.size + b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joins = (self.pair_keys[place] == key) & (self.rank[self.pair_piece[place]] < limit)
            result[at[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joins & ((ra > 0) | (rb > 0))
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)[go]
            a, b, at = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go], at[go]
        return result

    def pieces_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are a piece's, and its number. Few are, so a table of their first bits is
        asked before the sorted keys."""
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - MAYBE_BITS)])
        place = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        right = self.keys[place] == hashes[some]
        return some[right], self.piece[place[right]]

    def encode_words(self, words: np.ndarray, lengths: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
        """``words``: a row of code points per word, filled up behind its length, longest first. For each end place
        the last piece (UNKNOWN for a character without one) and its length."""
        count, length = words.shape
        power = np.array([pow(BASE, j, 1 << 64) for j in range(length + 1)], np.uint64)
        back = np.array([pow(pow(BASE, -1, 1 << 64), j, 1 << 64) for j in range(length + 1)], np.uint64)
        # a row per place, so that all words' sums at a place lie together
        sums = np.zeros((length + 1, count), np.uint64)
        np.cumsum((words.T.astype(np.uint64) + np.uint64(1)) * power[:length, None], axis=0, out=sums[1:])
        last = np.full((length + 1, count), NONE, np.int32)
        last[0] = FIRST
        step = np.zeros((length + 1, count), np.int32)
        for end in range(1, length + 1):
            # one step is open at each place, so a word that has it is done with the place
            left = np.arange(np.searchsorted(-lengths, -end, side="right"))
            for size in range(1, min(end, self.longest) + 1):
                hashes = (sums[end, left] - sums[end - size, left]) * back[end - size] + np.uint64(size)
                some, piece = self.pieces_of(hashes)
                if size == 1:
                    every = np.full(len(left), UNKNOWN)
                    every[some] = piece
                    some, piece = left, every
                stays = np.flatnonzero(pairs.follow(last[end - size, left[some]].astype(np.int64), piece))
                rows = left[some[stays]]
                last[end, rows], step[end, rows] = piece[stays], size
                if len(rows) == len(left):
                    break
                waits = np.ones(len(left), bool)
                waits[some[stays]] = False
                left = left[waits]
        return last.T, step.T

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def _pair(self, a: int, b: int) -> bool:
        return bool(self.follows(np.array([a]), np.array([b]))[0])

    def encode_long(self, word: str) -> list[int]:
        """The same search for one word."""
        last, step = [FIRST], [0]
        for end in range(1, len(word) + 1):
            for size in range(1, min(end, self.longest) + 1):
                piece = self.able.get(word[end - size : end], UNKNOWN if size == 1 else NONE)
                before = last[end - size]
                if piece != NONE and (piece < 0 or before < 0 or self._pair(before, piece)):
                    last.append(piece)
                    step.append(size)
                    break
        out, end = [], len(word)
        while end:
            out.append(self._ids(last[end], word[end - 1]))
            end -= step[end]
        return [i for ids in reversed(out) for i in ids]

    def _ids(self, piece: int, character: str) -> tuple[int, ...]:
        if piece != UNKNOWN:
            return (piece,)
        return tuple(self.bytes_at + b for b in character.encode("utf-8", "replace"))

    def encode_all(self, words: list[str], pairs: Pairs | None = None) -> dict[str, bytes]:
        """The ids of each word, as the bytes of 32-bit numbers."""
        pairs = pairs or Pairs(self)
        out: dict[str, bytes] = {}
        short = []
        for w in words:
            if len(w) > LONG:
                out[w] = array("i", self.encode_long(w)).tobytes()
            else:
                short.append(w)
        short.sort(key=len, reverse=True)
        at = 0
        while at < len(short):
            part = short[at : at + TOGETHER // len(short[at])]
            at += len(part)
            lengths, width = np.fromiter(map(len, part), np.int64, len(part)), len(part[0])
            codes = np.frombuffer("".join([w.ljust(width) for w in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), width)
            ids, strange = self._backward(*self.encode_words(codes, lengths, pairs), lengths)
            held = ids != NONE
            flat = ids[held].tobytes()
            ends = (4 * np.cumsum(held.sum(axis=1))).tolist()
            out.update(zip(part, [flat[s:e] for s, e in zip([0, *ends], ends)]))
            for k in strange.tolist():
                out[part[k]] = array("i", self.encode_long(part[k])).tobytes()
        return out

    @staticmethod
    def _backward(last: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that the backpointers name, in order, at the right of each word's row; and
        the words with a character that has no piece."""
        count, length = len(last), last.shape[1] - 1
        ids = np.full((count, length), NONE, np.int32)
        end, left = lengths, np.arange(count)
        for place in range(length - 1, -1, -1):
            if not len(left):
                break
            ids[left, place] = last[left, end]
            end = end - step[left, end]
            left, end = left[end > 0], end[end > 0]
        return ids, np.flatnonzero((ids == UNKNOWN).any(axis=1))

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of lists of ids: all ids, and how many each list has."""
        sizes = self.out_size[ids]
        data = memoryview(self.out_bytes[ranges(self.out_start[ids], sizes)])
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(counts)].tolist()
        texts = [str(data[s:e], "utf-8", "replace") for s, e in zip([0, *ends], ends)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def string_hash(text: str) -> int:
    return (sum((ord(c) + 1) * pow(BASE, j, 1 << 64) for j, c in enumerate(text)) + len(text)) & MASK


class Pairs:
    """Remembers which pairs of pieces follow each other, as many as its table has places."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.key, self.value = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (a != NONE) & (b != NONE)
        at = np.flatnonzero(out & (a >= 0) & (b >= 0))
        a, b = a[at], b[at]
        key = a * self.pieces.size + b
        slot = ((key.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        known = self.key[slot] == key
        out[at[known]] = self.value[slot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            found = self.pieces.follows(a[new], b[new])
            out[at[new]] = found
            self.key[slot[new]], self.value[slot[new]] = key[new], found
        return out


class Encoder:
    """Keeps the ids of words seen until they fill KNOWN_BYTES, by when the common ones are among
    them. A task has its own, which goes with it."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known, self.bytes, self.pairs = pieces, {}, 0, Pairs(pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.pieces.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        distinct = {u for p in parts for u in p}
        table = self.pieces.encode_all(list(distinct - self.known.keys()), self.pairs)
        more = WORD_BYTES * len(table)
        if self.bytes + more <= KNOWN_BYTES:
            more += sum([4 * len(w) + len(ids) for w, ids in table.items()])
        if self.bytes + more <= KNOWN_BYTES:
            self.known.update(table)
            self.bytes += more
            table = self.known
        else:
            table.update((w, self.known[w]) for w in distinct - table.keys())
        return [np.frombuffer(b"".join(map(table.__getitem__, p)), np.int32) for p in parts]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    bounds = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _encode(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        for part in slices(batches, limit=TEXT_BYTES):
            ids = encoder.encode(part.rows.column("_text").to_pylist())
            yield pa.record_batch({"doc_id": part.rows.column("doc_id"), "ids": _lists(ids)})

    return run


def _decode(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                texts = []
                for k in range(0, len(rows), 32):
                    some = rows.column("ids").slice(k, 32)
                    texts += pieces.decode_all(np.asarray(some.flatten(), np.int32), np.asarray(some.value_lengths().fill_null(0)))
                yield pa.record_batch({"doc_id": rows.column("doc_id"), "ids": rows.column("ids"), "text": pa.array(texts, pa.string())})

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids of every row, by the pair model in the file ``model``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInArrow(_encode(Pieces(model)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text of every row of doc_id, ids."""
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(_decode(Pieces(model)), "doc_id long, ids array<int>, text string")
