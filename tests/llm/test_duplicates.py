"""Exact dedup (op 3), SimHash (op 7) and components against plain loops."""

import hashlib
import random
import re
import uuid

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidelag.llm import digest_index, golay_simhash
from tidelag.llm.components import components
from tidelag.staging import shared_folder


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def loop_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append((i, t))
    out = []
    for i, t in rows:
        group = groups[normal(t)]
        best = max(group, key=lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0)))[0]
        out.append((i, best, len(group), i == best, hashlib.sha256(normal(t).encode()).hexdigest()))
    return out


def tidy(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def exact_of(df):
    return [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in df.collect()]


def test_exact_on_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert tidy(exact_of(digest_index.deduplicate(edges))) == tidy(loop_exact(rows))
    assert exact_of(digest_index.deduplicate(nothing)) == []
    kept = digest_index.keep_one(edges)
    assert kept.columns == edges.columns
    assert kept.count() == len({normal(t) for _, t in rows})


def test_index_remembers(spark, docs):
    name = f"digests_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    index = digest_index.DigestIndex(spark, name, path, 4)
    first = exact_of(index.add(docs([(5, "a b"), (6, "ab"), (7, "c")])))
    assert {(r[0], r[1], r[3]) for r in first} == {(5, 5, True), (6, 5, False), (7, 7, True)}
    index.drop()  # a later session opens the files again
    index = digest_index.DigestIndex(spark, name, path, 4)
    second = exact_of(index.add(docs([(1, "a  b and"), (2, "c "), (3, "new"), (4, "n e w")])))
    assert {(r[0], r[1], r[3]) for r in second} == {(1, 1, True), (2, 7, False), (3, 4, False), (4, 4, True)}
    assert sorted(r.keep_id for r in index.rows().collect()) == [1, 4, 5, 7]
    plan = index.rows().join(docs([(1, "x")]).select(digest_index.digest(F.col("text")).alias("digest")), "digest", "left_anti")
    assert "Bucketed: true" in plan._jdf.queryExecution().toString()
    index.drop()


def loop_prints(rows):
    out = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def loop_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_on_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    prints = loop_prints(rows)
    want = [(i, p, c) for (i, _), p, c in zip(rows, prints, loop_components([i for i, _ in rows], prints))]
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in golay_simhash.near_duplicates(edges).collect()]
    assert tidy(got) == tidy(want)
    assert golay_simhash.near_duplicates(nothing).collect() == []
    kept = golay_simhash.keep_one(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = set(loop_components(list(range(len(rows))), prints))
    assert set(ids) == {c for _, _, c in want} and len(ids) == len(groups)
    # columns named as the operator names its own
    clashing = edges.selectExpr("*", "'a' AS hash", "1 AS fp", "2 AS root", "3 AS id", "'m' AS mark", "4 AS row", "5 AS best")
    again = golay_simhash.keep_one(clashing)
    assert again.columns == clashing.columns and sorted([r.doc_id for r in again.collect()], key=str) == sorted(ids, key=str)


def test_simhash_keeps_one_of_rows_that_share_an_id(docs):
    rows = [(1, "one two three"), (1, "four five six"), (1, "four five six"), (None, "one two three"), (None, "seven"), (None, "eight"), (2, None), (3, "")]
    kept = [(r.doc_id, r.text or "") for r in golay_simhash.keep_one(docs(rows)).collect()]
    prints = loop_prints(rows)
    assert len(kept) == len({min(j for j in range(len(rows)) if bin(prints[j] ^ p).count("1") <= 3) for p in prints})
    assert (1, "one two three") in kept and (1, "four five six") in kept and (2, "") in kept and (None, "seven") in kept


def test_simhash_on_near_copies(docs):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(4000)}" for _ in range(400)] for _ in range(12)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    prints = loop_prints(rows)
    want = [(i, c) for (i, _), c in zip(rows, loop_components([i for i, _ in rows], prints))]
    assert len({c for _, c in want}) < 100
    assert sorted((r.doc_id, r.component_id) for r in golay_simhash.near_duplicates(docs(rows)).collect()) == want


def test_close_prints_share_a_key():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        near = prints.copy()
        for i in range(len(near)):
            for b in rng.choice(64, bits, replace=False):
                near[i] ^= np.uint64(1) << np.uint64(b)
        a, b = ({(o, k) for k, o in zip(*(x.tolist() for x in golay_simhash.fuzzy_keys(p)))} for p in (prints, near))
        assert {o for o, _ in a & b} == set(range(len(prints)))


def test_links_under_one_key_join_as_all_links_do():
    rng = np.random.default_rng(3)
    center = rng.integers(0, 2**64, 3, dtype=np.uint64)
    prints = np.unique([c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in center for a, b in rng.integers(0, 20, (30, 2))])
    for chunk in (prints, prints[:6]):
        a, b = golay_simhash.links_by_key(np.zeros(len(chunk), np.int64), chunk, 3)
        linked = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
        assert all(np.bitwise_count(chunk[x] ^ chunk[y]) <= 3 for x, y in linked)

        def parts(pairs):
            root = list(range(len(chunk)))
            for x, y in sorted(pairs) * len(chunk):
                root[x] = root[y] = min(root[x], root[y])
            return root

        every = {(i, j) for j in range(len(chunk)) for i in range(j) if np.bitwise_count(chunk[i] ^ chunk[j]) <= 3}
        assert parts(linked) == parts(every)
        assert len(chunk) < 9 or len(linked) < len(chunk)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)] + [(200, i) for i in range(201, 260)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {(i, 1) for i in range(2, 41)} | {(101, 100), (103, 100)} | {(i, 200) for i in range(201, 260)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stage_keeps_one_of_each_group(spark, docs):
    """The pipeline's stage against the components of loop_prints."""
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for words_, edits in ((100, 1), (60, 1), (400, 1), (400, 2), (900, 3), (900, 0)) * 8:
        w = [word() for _ in range(words_)]
        rows.append((len(rows), " ".join(w)))
        for i in rng.sample(range(words_), edits):
            w[i] = word()
        rows.append((len(rows), " ".join(w)))
    want = loop_components([i for i, _ in rows], loop_prints(rows))
    assert len(set(want)) < len(rows) - 12
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs(rows), "").collect()) == sorted(set(want))
