"""Substring dedup (ops 2 and 8) against plain loops."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidelag.llm import cover_dedup, run_index
from tidelag.llm.rolling import Slice, Spans, byte_spans, covered, runs, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def place(row):
    """Rows that share doc_id and text are one place; without doc_id they come first."""
    return (row[0] is not None, row[0] or 0, row[1] or "")


def loop_words(rows, window):
    seen = defaultdict(set)
    for r in rows:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])].add((place(r), i))
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if len(seen[tuple(w[i : i + window])]) > 1:
                gone[i : i + window] = [True] * window
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def loop_bytes(rows, length):
    first = {}
    for r in sorted(rows, key=place):
        b = (r[1] or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], (place(r), i))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] != (place(r), i):
                gone[i : i + length] = True
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((r[0], len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def tidy(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def random_rows(n=60):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(12)]
    pool = [" ".join(rng.choice(vocabulary) for _ in range(90)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(pool).split(" ")
            a = rng.randrange(60)
            w = w[a : a + rng.randint(20, 80)]
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "edit"
            parts.append(" ".join(w))
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    return rows


def words_of(df):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()]


def bytes_of(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()]


@pytest.mark.parametrize("window,period", [(35, 21), (6, 3)])
def test_words_on_random_texts(docs, window, period):
    rows = random_rows()
    assert tidy(words_of(cover_dedup.remove_repeats(docs(rows), window, period))) == tidy(loop_words(rows, window))


def test_words_on_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    got = cover_dedup.remove_repeats(edges)
    assert tidy(words_of(got)) == tidy(loop_words(rows, 35))
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert words_of(cover_dedup.remove_repeats(nothing)) == []


@pytest.mark.parametrize("entries", [run_index.KEY_ENTRIES, 2])
def test_bytes_on_random_texts(docs, monkeypatch, entries):
    monkeypatch.setattr(run_index, "KEY_ENTRIES", entries)
    rows = random_rows(40)
    assert tidy(bytes_of(run_index.remove_later(docs(rows)))) == tidy(loop_bytes(rows, 100))


def test_bytes_on_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert tidy(bytes_of(run_index.remove_later(edges))) == tidy(loop_bytes(rows, 100))
    assert bytes_of(run_index.remove_later(nothing)) == []


def test_index_marks_all_but_the_first():
    rng = random.Random(1)
    base = [bytes(rng.choice(b"ab c") for _ in range(300)) for _ in range(20)]
    texts = [b"a" * 161, b"a" * 150]
    for _ in range(200):
        b, s, n = rng.choice(base), rng.randrange(160), rng.randrange(100, 140)
        t = bytearray(b[s : s + n])
        t[rng.randrange(n)] = 120
        texts.append(bytes(t))
    phrase, offset = run_index.later_windows(texts, 100)
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for j in range(len(t) - 99):
            (want.add((i, j)) if t[j : j + 100] in seen else seen.add(t[j : j + 100]))
    assert set(zip(phrase.tolist(), offset.tolist())) == want


def edited_pieces(rng, alphabet, n):
    """Numbers of 5 texts, each with a piece of that text; half are edited, and some come again."""
    base = [bytes(rng.choice(alphabet) for _ in range(240)) for _ in range(5)]
    pieces = []
    for _ in range(n):
        b, s = rng.randrange(5), rng.randrange(80)
        t = bytearray(base[b][s : s + rng.randint(100, 160)])
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = rng.choice(alphabet)
        pieces.append((b, bytes(t)))
    return pieces + rng.choices(pieces, k=n)


def test_equal_phrases_are_indexed_once(monkeypatch):
    """The suffix order of a block grows with its different texts, not with their places."""
    built = []
    build = run_index.RunIndex.build
    monkeypatch.setattr(run_index.RunIndex, "build", lambda text, order, *more: built.append(len(order)) or build(text, order, *more))
    texts = [bytes(random.Random(i % 4).choices(range(256), k=150)) for i in range(40)]
    phrase, offset = run_index.later_windows(texts, 100)
    assert set(zip(phrase.tolist(), offset.tolist())) == {(i, j) for i in range(4, 40) for j in range(51)}
    assert built == [4 * 151]


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefghijklmnop \0", bytes(range(256))])
def test_parts_of_a_block(monkeypatch, alphabet):
    """Windows under one key meet in one part, whatever its size; a repeated row is one place."""
    rng = random.Random(3)
    rows = [(b, i, -i, 1000 * i << run_index.START, t) for i, (b, t) in enumerate(edited_pieces(rng, alphabet, 60))]
    want, seen = set(), set()
    for key, doc, tag, at, t in rows:
        for j in range(len(t) - 99):
            (want.add((doc, tag, (at >> run_index.START) + j)) if (key, t[j : j + 100]) in seen else seen.add((key, t[j : j + 100])))
    rows += rows[5:20]
    rng.shuffle(rows)
    block = pa.table({c: pa.array(v) for c, v in zip(("key", "doc", "tag", "at", "text"), zip(*rows))})
    for size in (1, 4000, 1 << 20):
        monkeypatch.setattr(run_index, "PART_BYTES", size)
        got = run_index._index_block(100)(block)
        spans = list(zip(*(got.column(c).to_pylist() for c in ("doc", "tag", "at"))))
        found = [(d, t, (a >> run_index.START) + j) for d, t, a in spans for j in range((a & 255) - 99)]
        assert len(found) == len(set(found)) and set(found) == want


def test_phrases_of_a_slice():
    """Consecutive windows of one document whose smallest gram stands at one place are one phrase."""
    rng = random.Random(8)
    sizes = [0, 30, 100, 99, 101, 500, 0, 130, 163, 5]
    texts = [bytes(rng.choices(b"abc", k=n)) for n in sizes] + [b"x" * 300]
    for chosen in (texts, texts[:2], [b""]):
        part = Slice(None, np.frombuffer(b"".join(chosen), np.uint8), np.append(0, np.cumsum([len(t) for t in chosen])))
        doc, start, windows, anchor, hashes, _ = run_index._phrases(part, 100, 39)
        want = []
        for d, t in enumerate(chosen):
            for s in range(part.off[d], part.off[d] + len(t) - 99):
                a = min(range(s, s + 62), key=lambda i: (hashes[i] >> np.uint64(32), i))
                if want and want[-1][0] == d and want[-1][3] == a:
                    want[-1][2] += 1
                else:
                    want.append([d, s, 1, a])
        assert [list(r) for r in zip(doc.tolist(), start.tolist(), windows.tolist(), anchor.tolist())] == want


def many_without_id():
    """A few thousand different texts without doc_id, some pairs alike at one offset, and some that share an id."""
    rng = random.Random(17)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = [noise(50) for _ in range(150)]
    rows = [(None if i % 4 else 5, f"{noise(rng.randint(1, 3))} {shared[i % 900]} {noise(2)}" if i % 900 < 150 else noise(rng.randint(1, 40))) for i in range(3000)]
    return rows + rows[:40]


def test_words_without_doc_id(docs):
    rows = many_without_id()
    got = cover_dedup.remove_repeats(docs(rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert tidy(map(tuple, got)) == tidy(loop_words(rows, 35))


def test_bytes_without_doc_id(docs, monkeypatch):
    """Of texts that share a doc_id or have none, the one of the smaller hash is earlier."""
    rows = many_without_id()
    hashes = {r.text: r.h for r in docs(rows).selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    monkeypatch.setitem(globals(), "place", lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    got = run_index.remove_later(docs(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert tidy((*r[:4], bytes(r[4])) for r in got) == tidy(loop_bytes(rows, 100))


def test_difference_cover():
    for period in (1, 2, 7, 13, 21):
        cover = cover_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    with pytest.raises(ValueError):
        cover_dedup.Shape(5, 6)


def test_kernels():
    texts = ["a bc", "", " d\te", "bc"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    part = Slice(None, buf, np.append(0, np.cumsum([len(t) for t in texts])))
    found = words(part)
    assert [buf[s:e].tobytes().decode() for s, e in zip(found.start, found.end)] == ["a", "bc", "d", "e", "bc"]
    assert found.counts.tolist() == [2, 0, 2, 1]
    hashes = byte_spans(buf).hash(found.start, found.end)
    assert hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4
    assert byte_spans(buf).windows(2).tolist() == byte_spans(buf).hash(np.arange(len(buf) - 1), np.arange(2, len(buf) + 1)).tolist()
    assert len(byte_spans(buf).windows(50)) == 0
    pairs = Spans(hashes).hash(np.array([0, 1]), np.array([2, 3]))
    assert pairs[0] != pairs[1]
    mask = covered(6, np.array([0, 1, 4]), np.array([2, 3, 6]))
    assert mask.tolist() == [True, True, True, False, True, True]
    assert [x.tolist() for x in runs(mask, np.array([0, 2, 6]))] == [[0, 2, 4], [2, 3, 6], [0, 1, 1]]
