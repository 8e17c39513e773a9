"""The in-task kernel: distances between one block of points and one block of candidates.

Spark decides which blocks meet and in which task. A join of rows would have to emit every
pair before it could cut to the nearest few; here a pair never becomes a row."""

from __future__ import annotations

import hashlib
import itertools
import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# The kernel travels inside the plan, so executors need numpy and pyarrow only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE_CELLS, NEAR_CELLS = 1 << 21, 1 << 19
CACHE_CELLS = 1 << 15
PROBE_CELLS = 1 << 17
BATCH_ROWS = 1 << 14
MIX_PRIME = 2147483647
PERMUTE_ROUNDS, PERMUTE_STEP, PERMUTE_SIDE = 6, 7919, 8
SPARE = 8
#: So few columns are found by looking for the least one again and again.
FEW_COLUMNS = 8


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed coordinate by coordinate in the given order."""
    out = np.empty((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    step = max(1, CACHE_CELLS // len(b))
    gap = np.empty((step, len(b)))
    for lo in range(0, len(a), step):
        rows, total = a[lo : lo + step], out[lo : lo + step]
        np.subtract(rows[:, 0, None], columns[0], out=total)
        total *= total
        for j in range(1, a.shape[1]):
            part = np.subtract(rows[:, j, None], columns[j], out=gap[: len(rows)])
            part *= part
            total += part
        np.sqrt(total, out=total)
    return out


def nearest_columns(d: np.ndarray, count: int):
    """The ``count`` nearest columns of each row in (distance, column) order."""
    if count == d.shape[1]:
        order = np.argsort(d, axis=1, kind="stable")
        return order, np.take_along_axis(d, order, 1)
    if count <= FEW_COLUMNS:
        return _least_columns(d, count)
    edge = np.partition(d, count - 1, axis=1)[:, count - 1 : count]
    inside = d < edge
    # Of the columns tied at the cut the first ones belong to the nearest.
    tied = d == edge
    room = count - inside.sum(1, keepdims=True)
    many = tied.sum(1) > room[:, 0]
    if many.any():
        tied[many] &= np.cumsum(tied[many], axis=1, dtype=np.int32) <= room[many]
    inside |= tied
    order = np.nonzero(inside)[1].reshape(len(d), count)
    near = np.take_along_axis(d, order, 1)
    by_distance = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(order, by_distance, 1), np.take_along_axis(near, by_distance, 1)


def _least_columns(d: np.ndarray, count: int):
    """The same for a small ``count``. Where a row has fewer finite distances, columns repeat with
    infinite ones. ``d`` is changed meanwhile and put back."""
    rows = np.arange(len(d))
    order, near = np.empty((len(d), count), np.int64), np.empty((len(d), count))
    for j in range(count):
        at = order[:, j] = d.argmin(1)
        near[:, j] = d[rows, at]
        d[rows, at] = np.inf
    for j in reversed(range(count)):
        d[rows, order[:, j]] = near[:, j]
    return order, near


def _slots(order, rows, hits, k):
    """Walk each row's candidates; entry j is the column holding the j-th draw, or -1.
    ``rows`` says which row of ``order`` a row of ``hits`` goes with."""
    seen = np.cumsum(hits, axis=1, dtype=hits.dtype)
    have = seen[:, -1]
    out = np.empty((len(hits), k), dtype=np.int64)
    for j in range(k):
        at = np.argmax(seen > j, axis=1)
        out[:, j] = np.where(have > j, order[rows, at], -1)
    return out, have


def _fold(slots):
    """Slots to (neighbours per row, columns, multiplicities)."""
    used = slots >= 0
    keep = used.copy()
    keep[:, 1:] &= slots[:, 1:] != slots[:, :-1]
    starts = np.cumsum(used.ravel())[keep.ravel()]
    return keep.sum(1), slots[keep], np.diff(np.append(starts, used.sum() + 1))


def depth_for(draws: np.ndarray, k: int, ties: bool = False) -> int:
    """How many columns to rank for the thinnest of ``draws`` that hold any. Of draws that hold
    every column the k nearest are enough, unless more may be tied with them."""
    width = draws.shape[1]
    held = (draws > 0).sum(1)
    if not held.any():
        return min(width, 1)
    if held.min() == width and not ties:
        return min(width, k)
    return min(width, math.ceil((k + SPARE) * width / held[held > 0].min()))


def probe(d: np.ndarray, draws: np.ndarray, k: int, ties: bool, ranked=None):
    """k nearest drawn candidates of each row of ``d``, for each draw in turn: neighbours
    per (draw, row), their columns, and how often each counts. With ``ties`` also all that are
    as near as the last one.

    ``draws[s, c]`` says how often draw s holds column c. Columns are ranked once, as far
    as the thinnest draw is likely to need; a row that runs out of ranked columns, or whose
    last place is tied with the last ranked column, is answered from its full distances, so
    the result is exact. ``ranked``: the columns in order and their distances, at least as
    deep, if they are known."""
    if draws.sum(1).max() < 1 << 15:
        draws = draws.astype(np.int16)
    height, width = d.shape
    depth = depth_for(draws, k, ties)
    order, near = nearest_columns(d, depth) if ranked is None else (x[:, :depth] for x in ranked)
    reachable = np.isfinite(near)
    partial = not reachable.all()
    at_once = max(1, PROBE_CELLS // order.size)
    found = []
    for lo in range(0, len(draws), at_once):
        part = draws[lo : lo + at_once]
        hits = part[:, order]
        if partial:
            hits *= reachable
        hits = hits.reshape(-1, depth)
        rows = np.tile(np.arange(height), len(part))
        slots, have = _slots(order, rows, hits, k)
        if ties:
            found.append(_with_ties(d, part, k, order, near, hits, rows, slots, have))
            continue
        if depth < width:
            _complete(d, part, k, slots, np.flatnonzero(have < k))
        found.append(_fold(slots))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _with_ties(d, draws, k, order, near, hits, rows, slots, have):
    """Neighbours no farther than the one in the last place."""
    limit = np.where(have >= k, d[rows, slots[:, -1]], np.inf)
    keep = (hits > 0) & (near[rows] <= limit[:, None])
    sizes, cols, mult = keep.sum(1), order[rows][keep], hits[keep]
    short = np.flatnonzero((have < k) | (limit == near[rows, -1]))
    if order.shape[1] == d.shape[1] or not len(short):
        return sizes, cols, mult
    answers = {}
    for i in short.tolist():
        s, r = divmod(i, len(d))
        members = np.flatnonzero(draws[s])
        own = d[r, members]
        at = np.flatnonzero(np.isfinite(own))
        at = at[np.argsort(own[at], kind="stable")]
        times = draws[s][members[at]]
        placed = own[at][np.cumsum(times) - times < k]
        at = at[own[at] <= placed[-1]] if len(at) else at
        answers[i] = members[at], draws[s][members[at]]
    ends = np.cumsum(sizes).tolist()
    parts = [answers[i] if i in answers else (cols[e - n : e], mult[e - n : e]) for i, (e, n) in enumerate(zip(ends, sizes.tolist()))]
    return np.array([len(c) for c, _ in parts]), np.concatenate([c for c, _ in parts]), np.concatenate([m for _, m in parts])


def _complete(d, draws, k, slots, short):
    """Answer the ``short`` (draw, row) pairs from all distances to the draw's members."""
    for s in np.unique(short // len(d)):
        mine = short[short // len(d) == s]
        members = np.flatnonzero(draws[s])
        full = d[np.ix_(mine % len(d), members)]
        order = np.argsort(full, axis=1, kind="stable")
        hits = draws[s][members][order] * np.isfinite(np.take_along_axis(full, order, 1))
        if len(members):
            slots[mine] = _slots(members[order], np.arange(len(mine)), hits, k)[0]


def _vectors(block: pa.StructArray, name: str = "v") -> np.ndarray:
    flat = block.field(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(block), -1)


def _numbers(block: pa.StructArray, name: str) -> np.ndarray:
    return block.field(name).to_numpy(zero_copy_only=False)


def _sorted_block(block: pa.StructArray) -> pa.StructArray:
    ids = _numbers(block, "i")
    if (ids[1:] > ids[:-1]).all():
        return block
    return block.take(pa.array(np.argsort(ids, kind="stable")))


def draw_positions(ticket: int, size: int, n: int, replacement: bool) -> np.ndarray:
    """Point numbers drawn for one sample; the same whole-number steps as the expressions
    mix_start, mix_middle and mix_end, and permuted."""
    return _drawn_numbers(ticket, np.arange(size, dtype=np.int64), n, replacement)


def _drawn_numbers(ticket, j: np.ndarray, n, replacement: bool) -> np.ndarray:
    """The ``j``-th draws; ``ticket`` and ``n`` are numbers, or arrays as long as ``j``."""
    if not replacement:
        return permuted(ticket, j, n)
    a = (ticket % MIX_PRIME + j) * 48271 % MIX_PRIME
    b = (a * a + (ticket >> 31)) % MIX_PRIME * 69621 % MIX_PRIME
    return ((b * b + ticket % MIX_PRIME) % MIX_PRIME * 65536 + b % 65536) % n


def permuted(ticket, j: np.ndarray, n) -> np.ndarray:
    """The ``j``-th numbers of a permutation of [0, n); of one each, if ``ticket`` and ``n`` are arrays."""
    rows = np.maximum(PERMUTE_SIDE, np.ceil(np.sqrt(n)).astype(np.int64))
    columns = np.maximum(PERMUTE_SIDE, (n + rows - 1) // rows)
    x = j.copy()
    left = np.arange(len(j))
    every = [np.broadcast_to(np.asarray(a, dtype=np.int64), j.shape) for a in (ticket, n, rows, columns)]
    while len(left):
        ticket, n, rows, columns = (a[left] for a in every)
        row, column = np.divmod(x[left], columns)
        for k in range(PERMUTE_ROUNDS):
            key = (ticket % MIX_PRIME * ((k + 1) * PERMUTE_STEP) + (ticket >> 31)) % MIX_PRIME
            u = ((column if k % 2 == 0 else row) + key) % MIX_PRIME * 48271 % MIX_PRIME
            add = ((u * u + (ticket >> 31)) % MIX_PRIME * 69621 % MIX_PRIME) >> 8
            if k % 2 == 0:
                row = (row + add) % rows
            else:
                column = (column + add) % columns
        x[left] = row * columns + column
        left = left[x[left] >= n]
    return x


def _rows(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            yield {name: batch.column(name)[r] for name in batch.schema.names}


def _gathered(batches):
    """Small batches put together: sending one costs about as much as thousands of rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pack_kernel(keys: list[str], columns: list[str], hits: bool = False):
    """For mapInArrow: rows of equal keys as one row with the list of their other columns,
    ``points``; ``hits`` adds a column that is null. Each batch is packed by itself, so keys that
    come in stretches give few lists."""
    names = [*columns, "hits"] if hits else columns

    def packed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy() for c in keys]
            order = np.lexsort(codes[::-1])
            new = np.ones(len(order), bool)
            new[1:] = np.any([code[order[1:]] != code[order[:-1]] for code in codes], axis=0)
            starts = np.flatnonzero(new)
            fields = [batch.column(c).cast(_nullable(batch.column(c).type)) for c in columns]
            if hits:
                fields.append(pa.nulls(len(order), pa.list_(pa.struct([("g", pa.int32()), ("m", pa.int32())]))))
            points = pa.StructArray.from_arrays(fields, names=names)
            if (order[1:] < order[:-1]).any():
                points = points.take(pa.array(order))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), points)
            at = pa.array(order[starts])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in keys] + [lists], names=[*keys, "points"])

    return packed


def _nullable(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([(f.name, _nullable(f.type)) for f in kind])
    return kind


class _Unit:
    """A block of points and the draws to answer for it."""

    def __init__(self, row, k, L, sample, E=None):
        self.head = {"series_id": row["series_id"], "E": pa.scalar(E, pa.int32()) if E else row["E"], "tau": row["tau"]}
        self.k = k or self.head["E"].as_py() + 1
        self.points = _sorted_block(row["points"].values)
        self.L, self.sample = L, sample


def _members(draws: pa.StructArray, n: int, replacement: bool) -> list[np.ndarray]:
    """The point numbers of each draw, sorted, so that the members of a chunk are a stretch."""
    drawn = zip(_numbers(draws, "ticket").tolist(), _numbers(draws, "size").tolist())
    return [np.sort(draw_positions(ticket, size, n, replacement)) for ticket, size in drawn]


def _drawn_from(members: list[np.ndarray], low: int, width: int) -> np.ndarray:
    """How often each draw holds each of ``width`` points numbered from ``low`` on."""
    draws = np.zeros((len(members), width), dtype=np.int32)
    for s, at in enumerate(members):
        mine = at[np.searchsorted(at, low) : np.searchsorted(at, low + width)] - low
        draws[s] = np.bincount(mine, minlength=width)
    return draws


def _drawn_by_rows(count: int, lib: pa.StructArray) -> np.ndarray:
    """The same from the draws that each member names."""
    hits = lib.field("hits")
    owner = np.repeat(np.arange(len(lib)), hits.value_lengths().to_numpy())
    flat = hits.flatten()
    draws = np.zeros((count, len(lib)), dtype=np.int32)
    np.add.at(draws, (_numbers(flat, "g"), owner), _numbers(flat, "m"))
    return draws


def unit_kernel(tile, k, ties, no_zero, distinct, replacement, in_task):
    """For mapInArrow, over rows sorted by unit and chunk: the row of a unit's points (chunk
    -1) comes first, then its candidates chunk by chunk. Each chunk gives the nearest of its
    own members, one row per (draw, point). ``k`` None stands for E + 1, the simplex around a
    point.

    ``in_task``: chunks are stretches of ``tile`` points, draws are made here, and one ranking
    serves them all. Else members name their draws, and each draw is measured on its own."""

    def answers(batches):
        unit, key, members = None, None, []
        for row in _rows(batches):
            mine = tuple(row[c].as_py() for c in ("series_id", "E", "tau", "block", "grp"))
            if mine != key:
                if row["chunk"].as_py() >= 0:
                    continue  # a block without points to answer for
                draws = row["draws"].values
                unit = _Unit(row, k, *(_numbers(draws, c).astype(np.int32) for c in ("L", "sample")))
                key, members = mine, _members(draws, row["n"].as_py(), replacement) if in_task else []
                continue
            lib, chunk = _sorted_block(row["points"].values), row["chunk"].as_py()
            held = _drawn_from(members, chunk * tile, len(lib)) if in_task else _drawn_by_rows(len(unit.L), lib)
            yield from _answers(unit, chunk, lib, np.minimum(held, 1) if distinct else held, ties, no_zero, not in_task)

    return lambda batches: _gathered(answers(batches))


def lag_kernel(k, ties, no_zero, distinct, replacement):
    """For mapInArrow, as unit_kernel with draws made in the task, for all E of a lag at once. A
    point has its longest vector; the vector of a smaller E is the front of it, so the squared
    distances of E + 1 are those of E and one more gap. Points and chunks follow i."""

    def one(head, rows):
        parts = _by_dimension(head, k, replacement)
        for row in rows:
            lib = _sorted_block(row["points"].values)
            yield from _lagged(parts[0][0].points, parts, row["chunk"].as_py(), lib, ties, no_zero, distinct)

    def short(held):
        found = _short_units(held, k, no_zero, distinct, replacement)
        if found is not None:
            yield found
        else:
            for head, row in held:
                yield from one(head, [row])

    def answers(batches):
        held, cells = [], 0
        for head, rows in _by_unit(batches):
            if head["n"].as_py() > SHORT_SERIES or ties:
                yield from one(head, rows)
                continue
            for row in rows:
                mine = len(head["draws"].values) * len(head["points"].values) * len(row["points"].values)
                if held and cells + mine > SHORT_CELLS:
                    yield from short(held)
                    held, cells = [], 0
                held.append((head, row))
                cells += mine
        if held:
            yield from short(held)

    return lambda batches: _gathered(answers(batches))


def _by_unit(batches):
    """Each unit's first row, and its chunks, which must be gone through before the next."""
    unit = lambda row: tuple(row[c].as_py() for c in ("series_id", "tau", "block", "grp"))
    for _, rows in itertools.groupby(_rows(batches), unit):
        head = next(rows)
        if head["chunk"].as_py() < 0:
            yield head, rows


#: Series of so many steps are answered many at a time, up to so many distances of all draws.
SHORT_SERIES, SHORT_CELLS = 128, 1 << 18


def _short_units(held, k, no_zero, distinct, replacement):
    """The answers of many units of short series at once, as _lagged gives them one by one: all
    candidates of a point are ranked, and each draw walks down the ranks. None if the steps of a
    unit have gaps."""
    sides = [_steps([row["points"].values for row in rows]) for rows in zip(*held)]
    if None in sides:
        return None
    (points, p_at, p_first), (libs, l_at, l_first) = sides
    of = [head["draws"].values for head, _ in held]
    draws = pa.concat_arrays(of)
    unit = np.repeat(np.arange(len(of)), [len(d) for d in of])
    E, n, L, size, sample, ticket = (_numbers(draws, c) for c in ("E", "n", "L", "size", "sample", "ticket"))
    tau = np.array([head["tau"].as_py() for head, _ in held])
    first = (E - 1) * tau[unit]

    # how often each draw holds each step of its chunk
    drawn = np.repeat(np.arange(len(draws)), size)
    j = np.arange(len(drawn)) - np.repeat(np.cumsum(size) - size, size)
    step = _drawn_numbers(ticket[drawn], j, n[drawn], replacement) + first[drawn] - l_first[unit[drawn]]
    width = l_at.shape[1]
    inside = (step >= 0) & (step < (l_at >= 0).sum(1)[unit[drawn]])
    times = np.bincount(drawn[inside] * width + step[inside], minlength=len(draws) * width).reshape(-1, width)
    if distinct:
        times = np.minimum(times, 1)

    a, b, a_i, b_i = _longest(points), _longest(libs), _numbers(points, "i"), _numbers(libs, "i")
    own = (a_i[p_at][:, :, None] == b_i[l_at][:, None, :]) | (l_at < 0)[:, None, :]
    total, parts = np.zeros(own.shape), []
    for dim in range(int(E.max(initial=0))):
        if dim < a.shape[1] and dim < b.shape[1]:
            gap = a[p_at, dim][:, :, None] - b[l_at, dim][:, None, :]
            gap *= gap
            total += gap
        mine = np.flatnonzero(E == dim + 1)
        if not len(mine):
            continue
        d = np.sqrt(total)
        d[own | np.isnan(d)] = np.inf
        if no_zero:
            d[d < 1e-30] = np.inf
        order = np.argsort(d, axis=2, kind="stable")
        near = np.take_along_axis(d, order, 2)
        # a row for each draw and point that has a vector of this length
        s, p = np.nonzero((p_at >= 0)[unit[mine]] & (p_first[unit[mine], None] + np.arange(p_at.shape[1]) >= first[mine][:, None]))
        s = mine[s]
        ranked = order[unit[s], p]
        hits = times[s[:, None], ranked] * np.isfinite(near[unit[s], p])
        before = np.cumsum(hits, axis=1) - hits
        places = k or dim + 2
        row, rank = np.nonzero((hits > 0) & (before < places))
        parts.append((
            s, p, np.bincount(row, minlength=len(s)), l_at[unit[s[row]], ranked[row, rank]],
            near[unit[s[row]], p[row], rank], np.minimum(hits, places - before)[row, rank],
        ))
    if not parts:
        parts = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0), np.zeros(0, np.int64))]
    s, p, sizes, cols, near, mult = (np.concatenate(x) for x in zip(*parts))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    found = (pa.array(b_i[cols]), pa.array(near), pa.array(mult.astype(np.int32)), libs.field("y").take(pa.array(cols)))
    names = pa.array([head["series_id"].as_py() for head, _ in held], pa.string())
    chunk = np.array([row["chunk"].as_py() for _, row in held], np.int64)
    at = pa.array(p_at[unit[s], p])
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(unit[s]))] + [pa.array(x[s].astype(np.int32)) for x in (E, tau[unit], L, sample)]
        + [pa.array(a_i).take(at), points.field("y").take(at)]
        + [pa.ListArray.from_arrays(offsets, x) for x in found] + [pa.array(chunk[unit[s]])],
        names=["series_id", "E", "tau", "L", "sample", "p", "y", "q", "d", "m", "yq", "chunk"],
    )


def _steps(blocks):
    """Blocks of consecutive steps put together and sorted: the steps; of each block their places,
    -1 behind the last; and its first step. None if a block has gaps."""
    block = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    size = np.bincount(block, minlength=len(blocks))
    steps = pa.concat_arrays(blocks)
    order = np.lexsort((_numbers(steps, "i"), block))
    steps = steps.take(pa.array(order))
    i = _numbers(steps, "i")
    if not size.all() or i.dtype != np.int64:
        return None
    start = np.cumsum(size) - size
    if (i - i[start][block] != np.arange(len(i)) - start[block]).any():
        return None
    at = start[:, None] + np.arange(size.max())
    return steps, np.where(np.arange(size.max()) < size[:, None], at, -1), i[start]


def _by_dimension(row, k, replacement):
    """For each E its unit, the place of its first point, and the members of its draws."""
    draws, tau = row["draws"].values, row["tau"].as_py()
    dimension, parts = _numbers(draws, "E"), []
    for E in np.unique(dimension).tolist():
        mine = draws.take(pa.array(np.flatnonzero(dimension == E)))
        unit = _Unit(row, k, *(_numbers(mine, c).astype(np.int32) for c in ("L", "sample")), E=E)
        parts.append((unit, (E - 1) * tau, _members(mine, mine.field("n")[0].as_py(), replacement)))
    return parts


def _longest(points: pa.StructArray) -> np.ndarray:
    """Vectors of different lengths as rows, the missing ends NaN."""
    v = points.field("v")
    size = v.value_lengths().to_numpy()
    out = np.full((len(points), int(size.max())), np.nan)
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _lagged(points, parts, chunk, lib, ties, no_zero, distinct):
    """Answers of one chunk for every E, from one pass over the coordinates."""
    a, b, a_i, b_i = _longest(points), _longest(lib), _numbers(points, "i"), _numbers(lib, "i")
    columns = np.ascontiguousarray(b.T)
    held = {}
    for unit, first, members in parts:
        low = int(np.searchsorted(b_i, first))
        found = _drawn_from(members, int(b_i[low]) - first, len(b_i) - low) if low < len(b_i) else None
        held[int(unit.head["E"].as_py())] = unit, first, low, np.minimum(found, 1) if distinct and found is not None else found
    step = max(1, TILE_CELLS // len(b_i))
    for lo in range(0, len(a_i), step):
        total = np.zeros((len(a_i[lo : lo + step]), len(b_i)))
        for j in range(max(held)):
            if j < a.shape[1] and j < b.shape[1]:
                gap = a[lo : lo + step, j, None] - columns[j]
                gap *= gap
                total += gap
            if j + 1 in held:
                unit, first, low, draws = held[j + 1]
                yield from _of_dimension(unit, points.slice(lo, step), first, chunk, lib, low, draws, total, ties, no_zero)


def _of_dimension(unit, part, first, chunk, lib, low, draws, squares, ties, no_zero):
    skip = int(np.searchsorted(_numbers(part, "i"), first))
    if skip == len(part):
        return
    part = part.slice(skip)
    if draws is None or not draws.any():
        none, total = np.zeros(0, np.int64), len(unit.L) * len(part)
        yield _batch(unit, part, chunk, lib, np.zeros(total, np.int64), none, none, np.zeros(0))
        return
    lib = lib.slice(low)
    d = _as_neighbours(np.sqrt(squares[skip:, low:]), _numbers(part, "i"), _numbers(lib, "i"), no_zero)
    sizes, cols, mult = _nearest(unit, d, draws, ties)
    near = d[np.repeat(np.tile(np.arange(len(part)), len(draws)), sizes), cols]
    yield _batch(unit, part, chunk, lib, sizes, cols, mult, near)


def every_kernel(k: int, no_zero: bool):
    """For mapInArrow, as unit_kernel, with every candidate a neighbour of one draw, numbered 0."""

    def answers(batches):
        unit, key = None, None
        for row in _rows(batches):
            mine = tuple(row[c].as_py() for c in ("series_id", "E", "tau", "block"))
            if mine != key:
                unit, key = _Unit(row, k, _zero, _zero), mine
                continue
            yield from _every(unit, unit.points, row["chunk"].as_py(), _sorted_block(row["points"].values), no_zero)

    return lambda batches: _gathered(answers(batches))


def walk_kernel(k, depth, ties, no_zero, distinct, replacement, seed):
    """For mapInArrow, over points with their ranks, in parts of other candidates each: their
    nearest members of every draw of ``runs``. ``open`` marks answers that the ranks may not hold
    to the end."""

    def answers(batches):
        unit, key, draws = None, None, []
        for row in _points_of(batches):
            mine = (row["series_id"], row["E"], row["tau"], row["n"])
            if mine != key:
                key = mine
                named = [(r["L"], s) for r in row["runs"] for s in range(r["samples"])]
                draws = [(L, s, *_counted_draw(seed, mine, L, s, replacement, distinct)) for L, s in named]
                L, sample = (np.array([d[j] for d in draws], np.int32) for j in range(2))
                unit = L, sample
            yield _walk(row, unit, draws, k or row["E"] + 1, depth, ties, no_zero)

    return lambda batches: _gathered(answers(batches))


def _points_of(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _counted_draw(seed, manifold, L, sample, replacement, distinct):
    """Point numbers of a draw in order, and how often each was drawn."""
    series, E, tau, n = manifold
    digits = hashlib.md5(f"{seed}:{series}:{E}:{tau}:{L}:{sample}".encode()).hexdigest()[:15]
    members, times = np.unique(draw_positions(int(digits, 16), min(L, n), n, replacement), return_counts=True)
    return members, np.ones_like(times) if distinct else times


def _walk(row, unit, draws, k, depth, ties, no_zero):
    """One point's answers for every draw."""
    shift = (row["E"] - 1) * row["tau"]
    q = np.array([i for part in row["parts"] for i in part["q"]], np.int64)
    d = np.array([x for part in row["parts"] for x in part["d"]], np.float64)
    yq = [x for part in row["parts"] for x in part["yq"]]
    # behind the last rank of a part that may go on, ranks are no longer all known
    ends = [(part["d"][-1], part["q"][-1]) for part in row["parts"] if len(part["q"]) == depth < part["seen"]]
    order = np.lexsort((q, d))
    q, d = q[order], d[order]
    known = len(q)
    if ends:
        last = min(ends)
        known = int(np.count_nonzero((d < last[0]) | ((d == last[0]) & (q <= last[1]))))
    if no_zero:
        keep = d >= 1e-30
        known = int(np.count_nonzero(keep[:known]))
        q, d, order = q[keep], d[keep], order[keep]
    found, open_ = [], []
    for _, _, members, times in draws:
        at = np.minimum(np.searchsorted(members, q[:known] - shift), len(members) - 1)
        hits = np.where(members[at] == q[:known] - shift, times[at], 0)
        before = np.cumsum(hits) - hits
        cols = np.flatnonzero((hits > 0) & (before < k))
        full = len(cols) and before[cols[-1]] + hits[cols[-1]] >= k
        if ties and full:
            cols = np.flatnonzero((hits > 0) & (d[:known] <= d[cols[-1]]))
            full = not ends or d[cols[-1]] < d[known - 1]
        found.append((cols, hits[cols] if ties else np.minimum(hits, k - before)[cols]))
        open_.append(bool(ends) and not full)
    sizes = [len(cols) for cols, _ in found]
    cols = np.concatenate([c for c, _ in found]).astype(np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    total = len(draws)
    lists = (q[cols], d[cols], np.concatenate([m for _, m in found]).astype(np.int32))
    arrays = [pa.array(x) for x in lists] + [pa.array([yq[order[c]] for c in cols.tolist()], pa.float64())]
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(row[c], kind), total) for c, kind in (("series_id", pa.string()), ("E", pa.int32()), ("tau", pa.int32()))]
        + [pa.array(x) for x in unit]
        + [pa.repeat(pa.scalar(row["pos"] + shift, pa.int64()), total), pa.repeat(pa.scalar(row["y"], pa.float64()), total)]
        + [pa.ListArray.from_arrays(offsets, x) for x in arrays]
        + [pa.repeat(pa.scalar(0, pa.int64()), total), pa.array(open_)],
        names=["series_id", "E", "tau", "L", "sample", "p", "y", "q", "d", "m", "yq", "chunk", "open"],
    )


def box_kernel(k: int, no_zero: bool):
    """For mapInArrow: each row pairs a box of points with a box of candidates, all of them one
    draw. ``reach``, if given, says how far each point still has to look; those that the box
    of the candidates does not come near enough to are left out. Answers name the box of points."""

    def answers(batches):
        for row in _rows(batches):
            unit, lib = _Unit(row, k, _zero, _zero), _sorted_block(row["lib"].values)
            points = unit.points
            if row["reach"].is_valid:
                points = points.take(pa.array(np.flatnonzero(_near_enough(points, lib, row["reach"].values))))
            for found in _every(unit, points, 0, lib, no_zero):
                place = [pa.repeat(row[c], found.num_rows) for c in ("slab", "box")]
                yield pa.RecordBatch.from_arrays([*found.columns, *place], names=[*found.schema.names, "slab", "box"])

    return lambda batches: _gathered(answers(batches))


_zero = np.zeros(1, np.int32)


def _near_enough(points, lib, reach) -> np.ndarray:
    far = dict(zip(_numbers(reach, "i").tolist(), _numbers(reach, "d").tolist()))
    limit = np.array([far.get(i, np.inf) for i in _numbers(points, "i").tolist()])
    v, cand = _vectors(points), _vectors(lib)
    gap = np.maximum(0.0, np.maximum(cand.min(0) - v, v - cand.max(0)))
    # scaled down by far more than rounding could have added
    return np.sqrt((gap * gap).sum(1)) * (1 - 1e-12) <= limit


def _every(unit, points, chunk, lib, no_zero):
    """Record batches of the k nearest of ``lib`` for each of ``points``."""
    cand, cand_i = _vectors(lib), _numbers(lib, "i")
    step = max(1, NEAR_CELLS // len(lib))
    for lo in range(0, len(points), step):
        part = points.slice(lo, step)
        order, near = nearest_columns(_measured(part, cand, cand_i, no_zero), min(unit.k, len(lib)))
        held = np.isfinite(near)
        yield _batch(unit, part, chunk, lib, held.sum(1), order[held], np.ones(int(held.sum()), np.int32), near[held])


def _measured(part, cand, cand_i, no_zero):
    return _as_neighbours(distances(_vectors(part), cand), _numbers(part, "i"), cand_i, no_zero)


def _as_neighbours(d, ids, cand_i, no_zero):
    """Distances, infinite where a candidate is no neighbour."""
    if np.isnan(d.sum()):
        d[np.isnan(d)] = np.inf
    if no_zero:
        d[d < 1e-30] = np.inf
    at = np.minimum(np.searchsorted(cand_i, ids), len(cand_i) - 1)
    own = np.flatnonzero(cand_i[at] == ids)
    d[own, at[own]] = np.inf
    return d


def _nearest(unit, d, draws, ties):
    """One ranking, as deep as the smallest library needs, and each library size looks as far
    down as it needs itself."""
    groups = np.split(np.arange(len(draws)), np.flatnonzero(unit.L[1:] != unit.L[:-1]) + 1)
    ranked = nearest_columns(d, max(depth_for(draws[g], unit.k, ties) for g in groups))
    found = [probe(d, draws[g], unit.k, ties, ranked) for g in groups]
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _nearest_alone(unit, part, cand, cand_i, draws, ties, no_zero):
    """Each draw measured on its own members; their distances, too, go with what was found."""
    found = []
    for s in range(len(draws)):
        cols = np.flatnonzero(draws[s])
        if len(cols):
            d = _measured(part, cand[cols], cand_i[cols], no_zero)
            sizes, at, mult = probe(d, draws[s : s + 1, cols], unit.k, ties)
            found.append((sizes, cols[at], mult, d[np.repeat(np.arange(len(part)), sizes), at]))
        else:
            found.append((np.zeros(len(part), np.int64), cols, cols, np.zeros(0)))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _answers(unit, chunk, lib, draws, ties, no_zero, alone):
    """Record batches of the nearest members of ``lib`` for each draw and point of the unit."""
    held = np.flatnonzero(draws.any(axis=0))
    if len(held) < len(lib):
        lib, draws = lib.take(pa.array(held)), draws[:, held]
    cand_i = _numbers(lib, "i")
    cand = _vectors(lib) if len(lib) else None
    step = max(1, (NEAR_CELLS if alone else TILE_CELLS) // max(1, len(lib)))
    for lo in range(0, len(unit.points), step):
        part = unit.points.slice(lo, step)
        total = len(draws) * len(part)
        if len(lib) and alone:
            sizes, cols, mult, near = _nearest_alone(unit, part, cand, cand_i, draws, ties, no_zero)
        elif len(lib):
            d = _measured(part, cand, cand_i, no_zero)
            sizes, cols, mult = _nearest(unit, d, draws, ties)
            near = d[np.repeat(np.tile(np.arange(len(part)), len(draws)), sizes), cols]
        else:
            sizes, cols, mult, near = np.zeros(total, np.int64), held, held, np.zeros(0)
        yield _batch(unit, part, chunk, lib, sizes, cols, mult, near)


def _batch(unit, part, chunk, lib, sizes, cols, mult, near):
    """A row for each draw and point; ``cols``: the members found, ``sizes`` of them in each row."""
    draws, total = len(unit.L), len(sizes)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    found = (pa.array(_numbers(lib, "i")[cols]), pa.array(near), pa.array(mult.astype(np.int32)), lib.field("y").take(pa.array(cols)))
    return pa.RecordBatch.from_arrays(
        [pa.repeat(unit.head[c], total) for c in ("series_id", "E", "tau")]
        + [pa.array(np.repeat(x, len(part))) for x in (unit.L, unit.sample)]
        + [
            pa.array(np.tile(_numbers(part, "i"), draws)),
            part.field("y").take(pa.array(np.tile(np.arange(len(part)), draws))),
        ]
        + [pa.ListArray.from_arrays(offsets, x) for x in found]
        + [pa.repeat(pa.scalar(chunk, pa.int64()), total)],
        names=["series_id", "E", "tau", "L", "sample", "p", "y", "q", "d", "m", "yq", "chunk"],
    )


def tree_kernel(keys: list[str]):
    """For mapInArrow: from a sample of each cell's vectors the tree of its cuts, as axis and place
    of every inner node, the children of node c (from 1) being 2c and 2c + 1."""

    def trees(batches):
        for row in _rows(batches):
            depth, sample = row["_depth"].as_py(), np.array(row["_sample"].as_py(), np.float64)
            axis, at = np.zeros((1 << depth) - 1, np.int32), np.zeros((1 << depth) - 1)
            held = {1: sample}
            for node in range(1, 1 << depth):
                mine = held.pop(node)
                if len(mine):
                    axis[node - 1] = j = int(np.argmax(mine.max(0) - mine.min(0)))
                    at[node - 1] = cut = float(np.partition(mine[:, j], (len(mine) - 1) // 2)[(len(mine) - 1) // 2])
                    left = mine[:, j] <= cut
                    held[2 * node], held[2 * node + 1] = mine[left], mine[~left]
                else:
                    held[2 * node] = held[2 * node + 1] = mine
            columns = [pa.repeat(row[c], 1) for c in keys]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array([depth], pa.int32()), pa.array([axis.tolist()], pa.list_(pa.int32())), pa.array([at.tolist()], pa.list_(pa.float64()))],
                names=[*keys, "_depth", "_axis", "_at"],
            )

    return lambda batches: _gathered(trees(batches))


def matrix_kernel(measure: str):
    """For mapInArrow: a tile of the all-pairs matrix, row by row; for two different blocks also
    the same tile column by column. Entries of a row with itself are left out."""

    def run(batches):
        for row in _rows(batches):
            points, others = _sorted_block(row["points"].values), _sorted_block(row["lib"].values)
            a, b = _vectors(points), _vectors(others)
            cells = distances(a, b) if measure == "euclidean" else _standardised(a) @ _standardised(b).T
            yield _one_side(row, points, others, row["q_block"], cells)
            if row["block"].as_py() != row["q_block"].as_py():
                yield _one_side(row, others, points, row["block"], np.ascontiguousarray(cells.T))

    return run


def _standardised(v):
    centred = v - v.mean(1, keepdims=True)
    norm = np.sqrt((centred * centred).sum(1, keepdims=True))
    flat = norm <= 1e-12 * np.abs(v).max(1, keepdims=True)
    return np.where(flat, 0.0, centred / np.where(flat, 1.0, norm))


def _one_side(row, points, others, block, cells):
    ids, other_ids = _numbers(points, "i"), _numbers(others, "i")
    wanted = (ids[:, None] != other_ids[None, :]) & np.isfinite(cells)
    sizes = wanted.sum(1)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    columns = np.broadcast_to(other_ids, wanted.shape)[wanted]
    return pa.RecordBatch.from_arrays(
        [pa.repeat(row[c], len(ids)) for c in ("series_id", "E", "tau")]
        + [pa.array(ids), pa.repeat(block, len(ids))]
        + [pa.ListArray.from_arrays(offsets, pa.array(columns)), pa.ListArray.from_arrays(offsets, pa.array(cells[wanted]))],
        names=["series_id", "E", "tau", "p", "q_block", "q", "d"],
    )


def summary_kernel(measure: str):
    """For mapInArrow: of each row of a tile of the all-pairs matrix the number, sum, least and
    largest of its cells; for two different blocks also of each column. Cells of a row with
    itself are left out, as are those that are no finite numbers. A tile is worked off in parts
    of a bounded number of cells."""

    def run(batches):
        for row in _rows(batches):
            sides = [_sorted_block(row[c].values) for c in ("points", "lib")]
            alike = row["block"].as_py() == row["q_block"].as_py()
            for block, side in zip(sides, _summaries(*sides, measure)[: 1 if alike else 2]):
                count, total, low, high = side
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(row[c], len(block)) for c in ("series_id", "E", "tau")]
                    + [pa.array(_numbers(block, "i")), pa.array(count), pa.array(total), pa.array(low, mask=none), pa.array(high, mask=none)],
                    names=["series_id", "E", "tau", "p", "pairs", "total", "low", "high"],
                )

    return run


#: Rows and columns of a part of a tile.
PART = 512, 2048
#: A squared distance taken from a product of vectors is exact enough above this share of the sum
#: of their squares, and above this share of such cells a part is measured cell by cell.
CLOSE, MANY_CLOSE = 1e-2, 0.1


def _summaries(points, others, measure):
    """(pairs, total, low, high) of each point over all others, and the other way round."""
    a, b = _vectors(points), _vectors(others)
    if measure != "euclidean":
        a, b = _standardised(a), _standardised(b)
    usable = [np.flatnonzero(np.isfinite(v).all(1)) for v in (a, b)]
    ids = [_numbers(block, "i")[at] for block, at in zip((points, others), usable)]
    sides = [[np.zeros(len(v), np.int64), np.zeros(len(v)), np.full(len(v), np.inf), np.full(len(v), -np.inf)] for v in (a, b)]
    a, b = (v[at] for v, at in zip((a, b), usable))
    for top in range(0, len(a), PART[0]):
        for left in range(0, len(b), PART[1]):
            parts = slice(top, top + PART[0]), slice(left, left + PART[1])
            cells = _distant(a[parts[0]], b[parts[1]]) if measure == "euclidean" else a[parts[0]] @ b[parts[1]].T
            out = _same_ids(*(x[p] for x, p in zip(ids, parts)))
            if not np.isfinite(cells.sum()):
                r, c = np.nonzero(~np.isfinite(cells))
                out = tuple(np.unique(np.concatenate([np.stack(out), np.stack([r, c])], axis=1), axis=1))
            for axis, (side, at, part) in enumerate(zip(sides, usable, parts)):
                mine = at[part]
                side[0][mine] += cells.shape[1 - axis] - np.bincount(out[axis], minlength=len(mine))
                cells[out] = 0.0
                side[1][mine] += cells.sum(1 - axis)
                cells[out] = np.inf
                side[2][mine] = np.minimum(side[2][mine], cells.min(1 - axis))
                cells[out] = -np.inf
                side[3][mine] = np.maximum(side[3][mine], cells.max(1 - axis))
    return sides


def _same_ids(a_i, b_i):
    """Places (row, column) of equal numbers in two sorted lists."""
    low, high = np.searchsorted(b_i, a_i, "left"), np.searchsorted(b_i, a_i, "right")
    times = high - low
    first = np.repeat(low - np.cumsum(times) + times, times)
    return np.repeat(np.arange(len(a_i)), times), first + np.arange(len(first))


def _distant(a, b):
    """Euclidean distances from products of the vectors; where two are so near to each other that
    digits would be lost, from their differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (a * a).sum(1), (b * b).sum(1)
        if not (np.isfinite(squares[0]).all() and np.isfinite(squares[1]).all()):
            return distances(a, b)
        bound = squares[0][:, None] + squares[1]
        cells = a @ b.T
        cells *= -2.0
        cells += bound
        bound *= CLOSE
        row, column = np.nonzero(cells <= bound)
        if len(row) > MANY_CLOSE * cells.size:
            return distances(a, b)
        np.sqrt(cells, out=cells)
    step = max(1, TILE_CELLS // max(1, a.shape[1]))
    for lo in range(0, len(row), step):
        r, c = row[lo : lo + step], column[lo : lo + step]
        gap = a[r] - b[c]
        cells[r, c] = np.sqrt((gap * gap).sum(1))
    return cells
