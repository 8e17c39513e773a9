"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's set holds its different shingles; equal sets are one node. A node's signature has
COORDINATES minima, and nodes are posted under each (coordinate, value) pair. Two sets of
similarity 0.85 agree in fewer than MATCHES of them with probability 2e-7, so only pairs with
MATCHES or more collisions are looked for. Values are counted first. Those that one node alone
has are skipped, and a node left with fewer than MATCHES of them can match nobody. Of the h
others, in the order of their counts, a node is posted under the rarest h - MATCHES + 1 only:
two nodes with MATCHES collisions meet in these prefixes. So a value that very many unrelated
documents have (of a common line, say) is no posting list unless it makes up most of a set.

In lists of FEW or fewer, all pairs are met; their sizes must allow the similarity, their
collisions are counted on whole signatures, and the pairs that reach MATCHES are compared on
full sets. Longer lists hold groups of near copies, and only what joins classes is needed of
them. Each node goes into one block of each of its first ROUNDS long lists; a block has BLOCK
shingles and is compared inside a task, set by set. Then every long list whose members are not
yet one class compares the members outside its largest class with all of its members, in blocks
too. So each pair that meets in a long list is either in one class already or compared, and no
pair of a list becomes a row. Where most members of a long list are not linked to each other,
this takes the square of their number, spread over blocks.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; with fewer words than a shingle the
whole sequence is one. Documents without words (null, empty, blank) have an empty set and are
linked with nothing. Repeated rows and rows without doc_id take part like any other;
component_id is null where no member has a doc_id. Empty tables give empty results. Extra
columns are ignored. Sets are told apart by 64 bits. A very long text is a slice and a block of
its own, at about 20 bytes a word."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage, unstage
from .components import components
from .rolling import Slice, Spans, byte_spans, mix, ranges, slices, words
from .shared import small_side

SHINGLE, LEAST = 3, 85
COORDINATES, MATCHES = 40, 21
FEW, ROUNDS = 24, 3
#: Shingles of a block compared inside itself, and of one compared with others.
BLOCK, WIDE_BLOCK = 1 << 16, 1 << 18
#: Pairs that a member may join to be counted one by one; columns of a matrix.
THIN, COLUMNS = 32, 1 << 10
SEED = np.random.Generator(np.random.PCG64(11)).integers(1, 2**64, COORDINATES, dtype=np.uint64)
PLACE_BITS = 6  # of a coordinate's number in a posting key


def shingle_sets(part: Slice, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each document, in order, and where each begins, and the end."""
    buf = np.where((part.buf >= 65) & (part.buf <= 90), part.buf + 32, part.buf).astype(np.uint8)
    found = words(part)
    spans, counts = Spans(byte_spans(buf).hash(found.start, found.end)), found.counts
    number = np.where(counts > 0, np.maximum(1, counts - shingle + 1), 0)
    first = ranges(found.first[:-1], number)
    value = spans.hash(first, first + np.repeat(np.minimum(counts, shingle), number))
    doc = np.repeat(np.arange(len(number)), number)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(number) + 1))


def node_numbers(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A number for each set, whatever the order of its members."""
    sums = np.append(np.uint64(0), np.cumsum(mix(value + np.uint64(1)), dtype=np.uint64))
    return (sums[off[1:]] - sums[off[:-1]]).view(np.int64)


def signatures(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of COORDINATES minima, 32 bits each, for each set that is not empty."""
    start = off[:-1][np.diff(off) > 0]
    out = np.zeros((len(start), COORDINATES), np.int32)
    if len(start):
        for j, seed in enumerate(SEED):
            out[:, j] = (np.minimum.reduceat(mix(value ^ seed), start) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _named(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value, off = shingle_sets(part, shingle)
            size = np.diff(off)
            at = np.append(0, np.cumsum(size > 0) * COORDINATES).astype(np.int32)
            yield pa.record_batch({
                "doc_id": part.rows.column("doc_id"), "hash": part.rows.column("hash"), "node": node_numbers(value, off), "n": size.astype(np.int64),
                "sig": pa.ListArray.from_arrays(pa.array(at), pa.array(signatures(value, off).ravel())),
            })

    return run


def _with_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value, off = shingle_sets(part, shingle)
            values = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.record_batch({
                "doc_id": part.rows.column("doc_id"), "hash": part.rows.column("hash"), "node": node_numbers(value, off),
                "n": np.diff(off).astype(np.int64), "values": values,
            })

    return run


# Blocks


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets of ``a`` and ``b`` share. Members that join many pairs make
    columns of 0/1 matrices, whose product counts them; the pairs of others are counted one by one."""
    value = np.concatenate([np.zeros(0, np.int64), *a, *b])
    sets = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    order = np.argsort(value, kind="stable")  # of one value, those of ``a`` first
    value, sets = value[order], sets[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    held = np.diff(np.append(first, len(value)))
    of_a = np.add.reduceat((sets < len(a)).astype(np.int64), first) if len(first) else held
    of_b = held - of_a
    out = np.zeros((len(a), len(b)), np.int64)
    thin = np.flatnonzero((of_a > 0) & (of_b > 0) & (of_a * of_b <= THIN))
    x = ranges(first[thin], of_a[thin])
    partners = np.repeat(of_b[thin], of_a[thin])
    y = ranges(np.repeat(first[thin] + of_a[thin], of_a[thin]), partners)
    np.add.at(out, (np.repeat(sets[x], partners), sets[y] - len(a)), 1)
    thick = np.flatnonzero(of_a * of_b > THIN)
    for low in range(0, len(thick), COLUMNS):
        columns = thick[low : low + COLUMNS]
        tables = np.zeros((len(a) + len(b), len(columns)), np.float32)
        tables[sets[ranges(first[columns], held[columns])], np.repeat(np.arange(len(columns)), held[columns])] = 1
        out += (tables[: len(a)] @ tables[len(a) :].T).astype(np.int64)
    return out


def similar(a: list[np.ndarray], b: list[np.ndarray], least: int) -> np.ndarray:
    """Which sets of ``a`` and ``b`` have 100 * shared >= least * all."""
    shared = common_counts(a, b)
    size = [np.array([len(s) for s in sets], np.int64) for sets in (a, b)]
    return 100 * shared >= least * (size[0][:, None] + size[1][None, :] - shared)


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all links of a symmetric table join."""
    rest, a, b = np.arange(len(linked)), [], []
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = linked[at, rest]
            a.append(np.full(int(near.sum()), at))
            b.append(rest[near])
            reached.extend(rest[near].tolist())
            rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows by their first ``keys`` columns, as lists of columns; array values as numpy arrays."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            names = batch.schema.names
            values = batch.column(names.index("values"))
            off = values.offsets.to_numpy()
            flat = values.values.to_numpy()
            plain = [batch.column(i).to_pylist() for i in range(len(names) - 1)]
            yield from zip(*plain, [flat[s:e].copy() for s, e in zip(off[:-1].tolist(), off[1:].tolist())])

    for key, group in groupby(rows(), key=lambda r: r[:keys]):
        yield key, [list(column) for column in zip(*group)]


def _inside(least: int):
    """Links inside blocks: rows are key, salt, node, values, sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (*_, node, sets) in _groups(batches, 2):
            a, b = spanning(similar(sets, sets, least))
            node = np.array(node, np.int64)
            yield pa.record_batch({"a": node[a], "b": node[b]})

    return run


def _across(least: int):
    """Links between blocks: rows are key, query block, target block, asks, node, label, values. Of
    a query's links to one class one stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (*_, asks, node, label, sets) in _groups(batches, 3):
            asks, node, label = np.array(asks, bool), np.array(node, np.int64), np.array(label, np.int64)
            q, t = np.flatnonzero(asks), np.flatnonzero(~asks)
            linked = similar([sets[i] for i in q], [sets[i] for i in t], least)
            x, y = np.nonzero(linked & (label[q][:, None] != label[t][None, :]))
            _, one = np.unique(np.stack([x, label[t][y]], axis=1), axis=0, return_index=True) if len(x) else (0, np.zeros(0, np.int64))
            yield pa.record_batch({"a": node[q[x[one]]], "b": node[t[y[one]]]})

    return run


# Postings


def posting_lists(nodes: DataFrame, matches: int) -> DataFrame:
    """key, node, n, m of the prefix postings of ``nodes`` (node, n, sig); m nodes share the key."""
    key = f"shiftleft(CAST(v AS BIGINT), {PLACE_BITS}) | j AS key"
    posted = nodes.selectExpr("node", "n", "posexplode(sig) AS (j, v)").selectExpr("node", "n", key)
    counts = stage(posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    held = posted.join(counts.hint("shuffle_merge"), "key").groupBy("node").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "key"))).alias("h")
    )
    prefix = held.where(F.size("h") >= matches).selectExpr("node", "n", f"explode(slice(h, 1, size(h) - {matches} + 1)) AS p")
    prefix = stage(prefix.select("node", "n", "p.key"))
    sizes = prefix.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    lists = stage(prefix.join(sizes.hint("shuffle_merge"), "key"))
    unstage(counts, prefix)
    return lists


def _pair_links(few: DataFrame, nodes: DataFrame, least: int, matches: int) -> DataFrame:
    """a, b: pairs that meet in short lists with enough collisions of their whole signatures."""
    a, b = (few.select("key", F.col("node").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    sizes = f"100 * least(n_a, n_b) >= {least} * greatest(n_a, n_b)"
    pairs = stage(a.join(b, "key").where(f"a < b AND {sizes}").select("a", "b").distinct())
    one, two = (nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    met = pairs.join(one.hint("shuffle_merge"), "a").join(two.hint("shuffle_merge"), "b")
    enough = stage(met.where(f"size(filter(zip_with(sig_a, sig_b, (x, y) -> x = y), e -> e)) >= {matches}").select("a", "b"))
    unstage(pairs)
    return enough


def _confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    one, two = (sets.select(F.col("node").alias(x), F.col("values").alias(f"values_{x}")) for x in "ab")
    both = pairs.join(two.hint("shuffle_merge"), "b").join(one.hint("shuffle_merge"), "a")
    counted = both.select("a", "b", F.size("values_a").alias("n"), F.size("values_b").alias("m"), F.size(F.array_intersect("values_a", "values_b")).alias("c"))
    return counted.where(f"100 * c >= {least} * (n + m - c)").select("a", "b")


def _in_blocks(rows: DataFrame, sets: DataFrame, keys: list[str], columns: list[str], kernel) -> DataFrame:
    """``rows`` with the sets of their nodes, dealt out and sorted by ``keys``, to the kernel."""
    full = rows.join(sets.select("node", "values").hint("shuffle_merge"), "node").select(*columns, "values")
    # blocks are few bytes for much work, so their number of tasks is not coalesced
    tasks = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(kernel, "a long, b long")


def _block_links(hot: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links inside one block of each of a node's first ROUNDS long lists."""
    first = "slice(sort_array(collect_list(struct(m, key))), 1, {}) AS firsts".format(ROUNDS)
    mine = hot.groupBy("node").agg(F.first("n").alias("n"), F.expr(first)).select("node", "n", F.explode("firsts").alias("f")).select("node", "n", "f.key")
    mine = stage(mine)
    blocks = mine.groupBy("key").agg(F.expr(f"(sum(n) + {BLOCK - 1}) div {BLOCK} AS blocks"))
    dealt = mine.join(blocks.hint("shuffle_merge"), "key").select("key", F.expr("pmod(xxhash64(node, key), blocks)").alias("salt"), "node")
    return _in_blocks(dealt, sets, ["key", "salt"], ["key", "salt", "node"], _inside(least))


def _rest_links(hot: DataFrame, sets: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """Links of the members outside the largest class of each long list with all its members."""
    named = hot.join(roots.hint("shuffle_merge"), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("label"))
    named = stage(named)
    classes = stage(named.groupBy("key", "label").agg(F.count("*").alias("members"), F.sum("n").alias("n")))
    lists = classes.groupBy("key").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.sum("n").alias("n"), F.max(F.struct("members", "label", "n"))["n"].alias("n_main"), F.count("*").alias("classes"))
    lists = stage(lists.where("classes > 1").selectExpr("key", "main", f"(n - n_main + {WIDE_BLOCK - 1}) div {WIDE_BLOCK} AS asking", f"(n + {WIDE_BLOCK - 1}) div {WIDE_BLOCK} AS asked"))
    open_ = stage(named.drop("n").join(lists.hint("shuffle_merge"), "key"))
    queries = open_.where("label <> main").selectExpr("key", "pmod(xxhash64(node, 1), asking) AS qb", "explode(sequence(0L, asked - 1)) AS tb", "true AS asks", "node", "label")
    targets = open_.selectExpr("key", "explode(sequence(0L, asking - 1)) AS qb", "pmod(xxhash64(node, 2), asked) AS tb", "false AS asks", "node", "label")
    keys = ["key", "qb", "tb"]
    return _in_blocks(queries.unionByName(targets), sets, keys, [*keys, "asks", "node", "label"], _across(least))


def links(nodes: DataFrame, sets_of, least: int = LEAST, matches: int = MATCHES) -> DataFrame:
    """node, root of the classes that links of ``least`` per cent make of ``nodes`` (node, n, sig); ``sets_of``
    gives the full sets (node, n, values) of some nodes."""
    lists = posting_lists(nodes, matches)
    few, hot = lists.where(f"m <= {FEW}"), lists.where(f"m > {FEW}")
    pairs = _pair_links(few, nodes, least, matches)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(hot.select("node"))
    sets = sets_of(stage(wanted.distinct()))
    found = stage(_confirmed(pairs, sets, least).unionByName(_block_links(hot, sets, least)))
    roots = stage(components(found))
    rest = stage(_rest_links(hot, sets, roots, least))
    if rest.isEmpty():
        return roots
    return components(rest.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, least: int = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row. Documents are linked from ``least`` per
    cent of shared shingles on, at which MATCHES is set; component_id is the smallest doc_id that
    links lead to, and kept says whether it is the row's own."""
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("hash"))
    named = stage(rows.mapInArrow(_named(shingle), "doc_id long, hash long, node long, n long, sig array<int>"))
    full = named.where("n > 0")
    # the row that stands for a node: texts are read again for its set, and nothing else is moved
    nodes = stage(full.groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "hash")).alias("rep")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        reps = nodes.join(wanted.hint("shuffle_merge"), "node", "left_semi").select(F.col("node").alias("_node"), F.col("rep.doc_id").alias("_doc"), F.col("rep.hash").alias("_hash"))
        sets = rows.mapInArrow(_with_sets(shingle), "doc_id long, hash long, node long, n long, values array<long>")
        same = (F.col("node") == F.col("_node")) & (F.col("hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
        return stage(sets.join(small_side(stage(reps), 48), same, "left_semi").dropDuplicates(["node"]).select("node", "n", "values"))

    roots = links(nodes.select("node", "n", "sig"), sets_of, least)
    owned = nodes.select("node", "first").join(roots.hint("shuffle_merge"), "node", "left")
    owned = stage(owned.select("node", "first", F.coalesce("root", "node").alias("root")))
    least_id = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(owned.join(least_id.hint("shuffle_merge"), "root").select("node", "component_id"))
    known = full.select("doc_id", "node", "n").join(classes.hint("shuffle_merge"), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
