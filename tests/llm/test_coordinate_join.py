"""MinHash classes (op 11) against all pairs of sets."""

import os
import random
import re

import numpy as np
import pytest

from tidelag.llm import coordinate_join

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


def shingles(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def loop(rows, least=85):
    """{(doc_id, text): (n_shingles, component_id)} by all pairs of different sets."""
    held = {}
    for i, t in rows:
        held.setdefault(shingles(t), []).append(i)
    sets = [s for s in held if s]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 100 * min(len(a), len(b)) >= least * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= least * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    first = {}
    for i, s in enumerate(sets):
        ids = [x for x in held[s] if x is not None]
        first.setdefault(find(i), []).extend(ids)
    component = {s: min(first[find(i)], default=None) for i, s in enumerate(sets)}
    out = [(i, len(shingles(t)), component[shingles(t)] if shingles(t) else i) for i, t in rows]
    return tidy((*r, r[0] == r[2]) for r in out)


def tidy(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def results(df):
    return tidy(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def near_copies(rng, groups, size, words, most):
    """Groups of copies of one text, each with some words replaced, so that similarities lie on
    both sides of the threshold."""
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(words), rng.randrange(most)):
                copy[at] = f"x{rng.randrange(4000)}"
            out.append(" ".join(copy))
    return out


def test_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert results(coordinate_join.near_duplicates(edges)) == loop(rows)
    assert coordinate_join.near_duplicates(nothing).count() == 0


def test_small_and_large_groups(docs):
    rng = random.Random(11)
    texts = near_copies(rng, 60, 5, 90, 7) + near_copies(rng, 2, 150, 120, 9) + near_copies(rng, 3, 30, 8, 2) + near_copies(rng, 1, 60, 150, 40)
    # unrelated texts around one long passage: posted lists of many members
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) + " " + passage for _ in range(120)]
    texts += [f"{passage} {rng.randrange(10**6)} tail" for _ in range(20)] + ["One Two", "one two", "one", "ONE", "", None]
    texts += texts[:40]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 3)) + [(None, texts[0]), (None, "only one without an id"), (3, texts[9])]
    got = results(coordinate_join.near_duplicates(docs(rows)))
    assert got == loop(rows)
    assert len({r[2] for r in got}) < len(rows) - 300


def test_long_lists_in_blocks(docs, monkeypatch):
    """Blocks of a few sets: what blocks and rounds leave open, the rest finds."""
    monkeypatch.setattr(coordinate_join, "BLOCK", 900)
    monkeypatch.setattr(coordinate_join, "WIDE_BLOCK", 2000)
    monkeypatch.setattr(coordinate_join, "FEW", 3)
    monkeypatch.setattr(coordinate_join, "ROUNDS", 1)
    rng = random.Random(5)
    rows = list(enumerate(near_copies(rng, 2, 120, 100, 12) + near_copies(rng, 20, 4, 60, 5)))
    assert results(coordinate_join.near_duplicates(docs(rows))) == loop(rows)


def test_counts_and_spanning_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in (1, 5, 400, 3000, 6000, 6000, 0)]
    other = sets[2:] + [np.unique(rng.integers(0, 12000, 700))]
    want = [[len(np.intersect1d(a, b)) for b in other] for a in sets]
    assert coordinate_join.common_counts(sets, other).tolist() == want
    linked = rng.random((40, 40)) < 0.04
    linked = linked | linked.T
    a, b = coordinate_join.spanning(linked)
    assert linked[a, b].all()
    want, got = (np.linalg.matrix_power((m | m.T | np.eye(40, dtype=bool)).astype(float), 40) > 0 for m in (linked, _table(a, b, 40)))
    assert (want == got).all() and len(a) < 40


def _table(a, b, n):
    out = np.zeros((n, n), bool)
    out[a, b] = True
    return out


def test_collisions_reach_the_threshold():
    """Pairs of similarity 0.85 agree in MATCHES coordinates."""
    rng = np.random.default_rng(1)
    reached = []
    for _ in range(1500):
        shared, a, b = np.split(rng.integers(1, 2**63, 170 + 15 + 15).astype(np.uint64), [170, 185])
        value, off = np.concatenate([shared, a, shared, b]), np.array([0, 185, 370])
        one, two = coordinate_join.signatures(value, off)
        reached.append(int((one == two).sum()))
    assert min(reached) >= coordinate_join.MATCHES
    assert abs(np.mean(reached) / coordinate_join.COORDINATES - 0.85) < 0.01


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_on_the_given_table(spark):
    from tidelag.llm import queries as llm

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert results(llm.queries()["op11_coordinate_join"](spark, SF)) == loop(rows)
