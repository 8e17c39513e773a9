import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelag import Spec, cross_map, neighbours
from tidelag.operators import embed, explode_neighbors, knn_in_library, lengths, pair_distances, rank_neighbors, simplex_forecast
from tidelag.operators import neighbors, simplex_predict, simplex_weights, tiles

# The nine-point series of the reference's worked example.
NINE = ([3, 4, 5, 6, 7, 1, 2, 5, 2], [7, 5, 8, 1, 3, 4, 3, 2, 1])


def frame(spark, series):
    rows = [
        (name, i, None if x is None else float(x), None if y is None else float(y))
        for name, (xs, ys) in series.items() for i, (x, y) in enumerate(zip(xs, ys))
    ]
    return spark.createDataFrame(rows, "series_id string, i bigint, x double, y double")


def coupled(n, seed=1):
    """x drives y weakly, y drives x strongly; neither leaves (0, 1)."""
    x, y = [0.4], [0.2]
    for _ in range(n - 1):
        a, b = x[-1], y[-1]
        x.append(a * (3.8 - 3.8 * a - 0.02 * b))
        y.append(b * (3.5 - 3.5 * b - 0.1 * a))
    return x, y


def assert_same(spark, spec, series):
    want = brute.cross_map(spec, {k: tuple([None if v is None else float(v) for v in s] for s in xy) for k, xy in series.items()})
    got = {tuple(r[:5]): r for r in cross_map(frame(spark, series), spec).collect()}
    assert set(got) == set(want)
    for key, (n_pred, rho, mae) in want.items():
        row = got[key]
        assert row.n_pred == n_pred, key
        assert row.rho == pytest.approx(rho, abs=1e-9), key
        assert row.rho_nonneg == pytest.approx(max(0.0, rho), abs=1e-9)
        assert (row.mae is None and mae is None) or row.mae == pytest.approx(mae, abs=1e-9), key


def mixed_series():
    rng = random.Random(3)
    return {
        "nine": NINE,
        "walk": ([rng.random() for _ in range(40)], [rng.random() for _ in range(40)]),
        "counts": ([rng.randrange(3) for _ in range(45)], [rng.randrange(5) for _ in range(45)]),
        "flat": ([2.0] * 12, [5.0] * 12),
        "short": ([1.0, 2.0], [2.0, 3.0]),
        "one": ([1.0], [2.0]),
    }


OPTIONS = {
    "default": {},
    "without replacement": {"replacement": False},
    "distinct": {"distinct_library": True},
    "ties": {"ties": "include"},
    "no zero": {"exclude_zero_distance": True},
    "library first": {"strategy": "library_first"},
    "shared": {"strategy": "shared"},
    "ties library first": {"ties": "include", "strategy": "library_first"},
    "no floor": {"weight_floor": 0.0},
    "ties without replacement": {"ties": "include", "replacement": False},
}


@pytest.mark.parametrize("name", OPTIONS)
def test_equals_plain_loops(spark, name):
    assert_same(spark, Spec(E=(1, 2, 3), tau=(1, 2), L=(1, 4, 30), samples=3, **OPTIONS[name]), mixed_series())


@pytest.mark.parametrize("name", [*OPTIONS][:4] + ["library first", "shared", "ties library first"])
def test_long_series_paths_equal_plain_loops(spark, small_blocks, name):
    """Libraries over one tile, many point blocks, answers merged."""
    assert_same(spark, Spec(E=(1, 3), tau=(2,), L=(2, 12, 35), samples=3, **OPTIONS[name]), mixed_series())


def test_missing_values(spark):
    rng = random.Random(5)

    def gappy():
        return [None if rng.random() < 0.15 else rng.random() for _ in range(40)]

    series = {"a": (gappy(), gappy()), "b": (gappy(), gappy())}
    for drop in (True, False):
        assert_same(spark, Spec(E=(1, 2), tau=(1,), L=(6, 20), samples=3, drop_missing=drop), series)


def test_dropped_vectors_across_stretches(spark):
    x = [None if i % 5 == 0 else float(i) for i in range(30)]
    got = embed(frame(spark, {"a": (x, x)}), [(2, 1)], drop_missing=True, stretch=4).orderBy("i").collect()
    want = brute.points(x, 2, 1, drop_missing=True)
    assert [(r.i, r.v, r.pos, r.n) for r in got] == [(i, v, p, len(want)) for p, (i, v) in enumerate(want)]


def test_does_not_depend_on_partitions(spark):
    series = frame(spark, {"a": coupled(60), "b": coupled(80)})
    spec = Spec(E=(2,), tau=(1,), L=(10, 25), samples=4)
    first = sorted(map(tuple, cross_map(series.repartition(1), spec).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = sorted(map(tuple, cross_map(series.repartition(7, "x"), spec).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for a, b in zip(first, again, strict=True):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], abs=1e-12)


def test_full_library_without_replacement_is_the_same_for_all_samples(spark):
    rows = cross_map(frame(spark, {"a": coupled(50)}), Spec(E=(2,), L=(1000,), samples=4, replacement=False)).collect()
    assert len({round(r.rho, 12) for r in rows}) == 1


def test_skill_grows_with_the_library(spark):
    x, y = coupled(300)
    rows = cross_map(frame(spark, {"xy": (y, x), "self": (x, x)}), Spec(E=(2,), L=(10, 60, 250), samples=20)).collect()
    mean = {
        (s, L): sum(r.rho for r in rows if (r.series_id, r.L) == (s, L)) / 20 for s in ("xy", "self") for L in (10, 60, 250)
    }
    assert mean["self", 250] > 0.99
    assert mean["xy", 10] < mean["xy", 60] < mean["xy", 250]
    assert all(-1 <= r.rho <= 1 for r in rows)


@pytest.mark.parametrize("E,k,no_zero", [(2, 5, False), (2, 5, True), (6, 4, False), (3, None, True), (1, 3, False)])
def test_rank_table(spark, small_blocks, E, k, no_zero):
    """Short manifolds, boxes over all coordinates, many copies, a point far from all others."""
    series = mixed_series()
    rng = random.Random(8)
    series["copies"] = ([1.0] * 40 + [float(rng.randrange(4)) for _ in range(60)] + [1.0] * 30, [0.0] * 130)
    x, y = coupled(300)
    series["long"] = ([*x, 1e6, *x[:7]], [*y, 0.0, *y[:7]])
    points = embed(frame(spark, series), [(E, 1)])
    got = {}
    for r in rank_neighbors(points, k, no_zero).orderBy("p", "r").collect():
        got.setdefault((r.series_id, r.p), []).append((r.q, r.d, r.r))
    for name, (x, _) in series.items():
        pts = brute.points([float(v) for v in x], E, 1)
        for i, v in pts:
            near = sorted((brute.distance(v, w), q) for q, w in pts if q != i)
            near = [(q, d) for d, q in near if not (no_zero and d < 1e-30)][:k]
            assert got.get((name, i), []) == [(q, d, r + 1) for r, (q, d) in enumerate(near)]


def test_pair_distances(spark, small_blocks):
    x = [float(v) for v in mixed_series()["counts"][0]]
    points = embed(frame(spark, {"a": (x, x)}), [(2, 1)])
    cells = {(r.p, q): d for r in pair_distances(points).collect() for q, d in zip(r.q, r.d)}
    pts = brute.points(x, 2, 1)
    assert cells == {(i, q): brute.distance(v, w) for i, v in pts for q, w in pts if i != q}
    # each pair of blocks meets once
    rows = pair_distances(points).collect()
    assert len({(r.p, r.q_block) for r in rows}) == len(rows)
    sums = pair_distances(points, summarise=True).groupBy().sum("pairs", "total").first()
    assert sums[0] == len(cells) and sums[1] == pytest.approx(sum(cells.values()))


def test_pairs_of_blocks_are_dealt_evenly(spark, small_blocks, monkeypatch):
    x = [float(v) for v in range(84)]
    points = embed(frame(spark, {"a": (x, x)}), [(1, 1)])
    hosts = {}
    monkeypatch.setattr(neighbors, "deal_out", lambda units, *keys: [hosts.setdefault(r.block, []).append(r.q_block) for r in units.collect()] and units)
    pair_distances(points)
    assert sorted({tuple(sorted((h, v))) for h, visitors in hosts.items() for v in visitors}) == [(a, b) for a in range(12) for b in range(a, 12)]
    assert sum(map(len, hosts.values())) == 12 * 13 // 2 and max(map(len, hosts.values())) <= 7


def test_forecast_forms_agree(spark):
    found = neighbours(frame(spark, mixed_series()), Spec(E=(2, 3), L=(8,), samples=3))
    fast = {tuple(r[:6]): r.y_hat for r in simplex_forecast(found, 4).collect()}
    slow = {tuple(r[:6]): r.y_hat for r in simplex_predict(simplex_weights(found)).collect()}
    assert set(fast) == set(slow)
    for key, value in fast.items():
        assert (value is None and slow[key] is None) or value == pytest.approx(slow[key], abs=1e-12)


def test_neighbour_rows(spark):
    rows = explode_neighbors(neighbours(frame(spark, {"n": NINE}), Spec(E=(2,), L=(6,), samples=2))).collect()
    for r in rows:
        assert r.p != r.q and r.yq == NINE[1][r.q] and 1 <= r.m <= 3
    taken = {}
    for r in rows:
        taken[r.sample, r.p] = taken.get((r.sample, r.p), 0) + r.m
    assert max(taken.values()) <= 3


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 60), st.integers(1, 5), st.integers(1, 4), st.integers(0, 10**6), st.booleans())
def test_probe_equals_a_plain_walk(rows, cols, k, draws, seed, ties):
    rng = np.random.default_rng(seed)
    d = rng.integers(0, 6, (rows, cols)).astype(float)
    d[rng.random((rows, cols)) < 0.1] = np.inf
    held = rng.integers(0, 3, (draws, cols)).astype(np.int32)
    held[rng.random((draws, cols)) < 0.6] = 0
    sizes, picked, mult = tiles.probe(d, held, k, ties)
    assert len(sizes) == draws * rows and sizes.sum() == len(picked) == len(mult)
    ends = np.cumsum(sizes)
    for s, draw in enumerate(held):
        for r in range(rows):
            want, places = [], k
            for c in sorted(range(cols), key=lambda c: (d[r, c], c)):
                if draw[c] == 0 or math.isinf(d[r, c]):
                    continue
                if places > 0:
                    want.append((c, int(draw[c]) if ties else min(int(draw[c]), places)))
                    places -= int(draw[c])
                elif ties and d[r, c] == d[r, want[-1][0]]:
                    want.append((c, int(draw[c])))
            end = ends[s * rows + r]
            at = end - sizes[s * rows + r]
            assert list(zip(picked[at:end].tolist(), mult[at:end].tolist())) == want


def test_thin_draws_fall_back_to_all_distances():
    rng = np.random.default_rng(0)
    d = rng.random((50, 4000))
    held = np.zeros((2, 4000), dtype=np.int32)
    held[0, rng.integers(0, 4000, 400)] = 1
    held[1, np.argsort(d[0])[-400:]] = 1
    sizes, picked, _ = tiles.probe(d, held, 3, False)
    assert (sizes == 3).all()
    for s, draw in enumerate(held):
        members = np.flatnonzero(draw)
        for r in range(50):
            at = 3 * (50 * s + r)
            assert picked[at : at + 3].tolist() == members[np.argsort(d[r, members], kind="stable")[:3]].tolist()


def test_short_series_are_answered_together(spark, monkeypatch):
    """Many short series, some with missing values or too few steps, share calls and keep their answers."""
    rng = np.random.default_rng(11)
    series = {f"s{j}": [(None if rng.random() < 0.1 else float(rng.integers(0, 9)), float(rng.random())) for _ in range(2 + j % 20)] for j in range(30)}
    df = spark.createDataFrame(
        [(name, i, x, y) for name, rows in series.items() for i, (x, y) in enumerate(rows)], "series_id string, i bigint, x double, y double"
    )
    columns = [*neighbors.POINT, "q", "d", "m", "yq"]
    for options in ({}, {"replacement": False}, {"distinct_library": True}, {"exclude_zero_distance": True}):
        spec = Spec(E=(2, 3), tau=(2,), L=(3, 9), samples=2, strategy="shared", **options)
        points = embed(df, spec.pairs)
        found = []
        for longest in (tiles.SHORT_SERIES, 0):
            with monkeypatch.context() as m:
                m.setattr(tiles, "SHORT_SERIES", longest)
                rows = knn_in_library(points, spec, sizes=lengths(df, spec.pairs), pairs=spec.pairs).select(*columns).collect()
            found.append(sorted(map(tuple, rows), key=lambda r: r[:6]))
        assert found[0] == found[1] and len(found[0]) > 1000
    calls = []
    monkeypatch.setattr(tiles, "_by_dimension", lambda *a: calls.append(a))
    packed = [
        {"series_id": f"s{j}", "tau": 1, "n": 6, "block": 0, "grp": 0, "chunk": chunk, "points": [{"i": i, "y": 0.0, "v": [float(i), float(i)]} for i in range(1, 6)],
         "draws": [{"E": 2, "n": 5, "L": 3, "size": 3, "sample": 0, "ticket": 7}] if chunk < 0 else None}
        for j in range(40) for chunk in (-1, 0)
    ]
    out = list(tiles.lag_kernel(None, False, False, False, True)([pa.RecordBatch.from_pylist(packed)]))
    assert not calls and sum(b.num_rows for b in out) == 40 * 5
