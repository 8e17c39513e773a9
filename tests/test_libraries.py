"""Draws without a sort, given libraries, and what each strategy ships."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cross_map import coupled, frame, mixed_series

from tidelag import Spec, cross_map, neighbours
from tidelag.functions import permuted
from tidelag.operators import draw_libraries, embed, explode_neighbors, knn_in_library, lengths, library_points, neighbors, tiles


def test_permutation_of_every_length():
    for n in [*range(1, 130), 1000, 1023, 1025, 59999]:
        for ticket in (0, 7, 1 << 45, (1 << 60) - 1):
            assert sorted(tiles.permuted(ticket, np.arange(n), n).tolist()) == list(range(n))


def test_permutation_in_sql_equals_the_kernel(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(1 << 60), j, n) for n in (1, 2, 3, 5, 17, 50, 1000, 10**6 + 3, 10**9 + 7) for j in {0, n // 2, n - 1, rng.randrange(n)}]
    rows += [(t, j, 7) for t in range(40) for j in range(7)]
    got = permuted(spark.createDataFrame(rows, "t bigint, j bigint, n bigint"), "x", "t", "j", "n").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.x == tiles.permuted(r.t, np.array([r.j]), r.n)[0], r


def test_permutation_has_no_favourites():
    """First and second numbers of many draws: each point, and each pair of points, equally often."""
    rng = np.random.default_rng(4)
    n, draws = 12, 60_000
    first = np.array([tiles.permuted(int(t), np.arange(2), n) for t in rng.integers(0, 1 << 60, draws)])
    single = np.bincount(first[:, 0], minlength=n)
    pairs = np.bincount(first[:, 0] * n + first[:, 1], minlength=n * n).reshape(n, n)
    chi = ((single - draws / n) ** 2 / (draws / n)).sum()
    off = pairs[~np.eye(n, dtype=bool)]
    chi_pairs = ((off - draws / off.size) ** 2 / (draws / off.size)).sum()
    assert np.trace(pairs) == 0
    assert chi < 35 and chi_pairs < 200  # 11 and 131 degrees of freedom


@pytest.mark.parametrize("replacement", [True, False])
def test_draw_table(spark, replacement):
    spec = Spec(E=(2,), tau=(1, 3), L=(5, 40), samples=3, replacement=replacement)
    series = mixed_series()
    got = {}
    for r in draw_libraries(lengths(frame(spark, series), spec.pairs), spec).collect():
        got.setdefault((r.series_id, r.E, r.tau, r.L, r.sample), {})[r.pos] = r.m
    want = {
        (name, E, tau, L, s): brute.library(spec, name, E, tau, L, s, len(x) - (E - 1) * tau)
        for name, (x, _) in series.items() for E, tau in spec.pairs for L in spec.L for s in range(3) if len(x) > (E - 1) * tau
    }
    assert got == want


LIBRARY = "series_id string, E int, tau int, L int, sample int, idx bigint, m int, n string"


def given_rows(rng):
    """Members with weights, repeated rows, members that are no point, other manifolds, nulls."""
    rows = [
        (name, E, 1, 10 * L, s, rng.randrange(45), rng.choice([1, 1, 2, 3, None]), "x")
        for name in ("walk", "counts", "nine") for E in (1, 2) for L in (1, 2) for s in range(3) for _ in range(6 * L)
    ]
    return rows + [("walk", 1, 1, 99, 0, 500, 1, ""), ("nobody", 1, 1, 5, 0, 1, 1, ""), ("walk", 2, 1, 10, 0, None, 1, ""), ("walk", 2, 1, 10, 7, 3, 0, "")]


@pytest.mark.parametrize("ties,distinct,small", [("ignore", False, False), ("include", False, True), ("ignore", True, True), ("ignore", False, True)])
def test_given_library(spark, request, ties, distinct, small):
    if small:
        request.getfixturevalue("small_blocks")
    rows, series = given_rows(random.Random(9)), mixed_series()
    spec = Spec(E=(1, 2), tau=(1,), ties=ties, distinct_library=distinct)
    got = {}
    for r in explode_neighbors(neighbours(frame(spark, series), spec, library=spark.createDataFrame(rows, LIBRARY))).collect():
        got.setdefault((r.series_id, r.E, r.L, r.sample, r.p), []).append((r.q, r.d, r.m))
    want = {}
    for name, (x, _) in series.items():
        for E in (1, 2):
            pts = brute.points([float(v) for v in x], E, 1)
            number = {i: pos for pos, (i, _) in enumerate(pts)}
            draws = {}
            for s, e, _, L, sample, idx, m, _ in rows:
                if (s, e) == (name, E) and idx in number and m != 0:
                    draw = draws.setdefault((L, sample), {})
                    draw[number[idx]] = draw.get(number[idx], 0) + (1 if m is None else m)
            for (L, sample), lib in draws.items():
                lib = dict.fromkeys(lib, 1) if distinct else lib
                for i, v in pts:
                    kept = brute.neighbours(spec, pts, lib, i, v, E + 1)
                    if kept:
                        want[name, E, L, sample, i] = kept
    assert got == want


def test_given_library_without_rows(spark):
    none = spark.createDataFrame([], LIBRARY)
    assert cross_map(frame(spark, mixed_series()), Spec(E=(2,)), library=none).count() == 0


def shipped(monkeypatch, points, spec, sizes):
    """How many points the chunks of each plan hold, over all blocks, and whether draws are made in the task."""
    seen = []

    def kept(blocks, chunks, spec, k, in_task):
        seen.append((in_task, chunks.agg(F.sum(F.size("points"))).first()[0], blocks.count()))
        return spark_rank(blocks, chunks, spec, k, in_task)

    spark_rank = neighbors._rank_units
    with monkeypatch.context() as m:
        m.setattr(neighbors, "_rank_units", kept)
        knn_in_library(points, spec, sizes=sizes)
    return seen


def test_only_members_are_shipped(spark, small_blocks, monkeypatch):
    series = frame(spark, {"a": coupled(300), "b": coupled(20)})
    points = embed(series, [(2, 1)])
    for replacement in (True, False):
        spec = Spec(E=(2,), L=(6,), samples=2, replacement=replacement)
        want = 0
        for name, n in (("a", 299), ("b", 19)):
            members = set().union(*[brute.library(spec, name, 2, 1, 6, s, n) for s in range(2)])
            want += len(members) * -(-n // max(5, min(9, n // 16)))
        seen = shipped(monkeypatch, points, spec, lengths(series, [(2, 1)]))
        assert [(in_task, held) for in_task, held, _ in seen] == [(False, want)]


def test_auto_chooses_for_each_manifold(spark, monkeypatch):
    """Ten draws of 12 are fewer than 299 points, and more than 59."""
    series = frame(spark, {"a": coupled(300), "b": coupled(60)})
    spec = Spec(E=(2,), L=(12,), samples=10)
    seen = shipped(monkeypatch, embed(series, [(2, 1)]), spec, lengths(series, [(2, 1)]))
    assert [in_task for in_task, *_ in seen] == [True, False]
    results = []
    for strategy in ("auto", "shared", "library_first"):
        rows = cross_map(series, Spec(E=(2,), L=(12,), samples=10, strategy=strategy)).collect()
        results.append(sorted((tuple(r[:6]), round(r.rho, 9), round(r.mae, 9)) for r in rows))
    assert len(results[0]) == 20 and results[0] == results[1] == results[2]


def test_plans_differ(spark):
    """Library first meets a table of draws, which the shared plan does not have."""
    series = frame(spark, {"a": coupled(100)})

    def plan(strategy):
        found = neighbours(series, Spec(E=(2,), L=(10,), strategy=strategy))
        return found._jdf.queryExecution().executedPlan().toString()

    assert plan("shared").count("Join") < plan("library_first").count("Join")
    assert plan("library_first").count("Exchange") > plan("shared").count("Exchange")


def test_ties_rank_no_deeper():
    """Many columns at the edge of the ranking: the rows tied there are answered from all distances."""
    rng = np.random.default_rng(6)
    d = rng.integers(0, 4, (30, 3000)).astype(float)
    held = (rng.random((3, 3000)) < 0.4).astype(np.int32)
    assert tiles.depth_for(held, 4) < 60
    sizes, cols, mult = tiles.probe(d, held, 4, True)
    ends = np.cumsum(sizes)
    for s, draw in enumerate(held):
        for r in range(30):
            i = s * 30 + r
            members = np.flatnonzero(draw)
            limit = np.sort(d[r, members])[3]
            want = [c for c in members[np.argsort(d[r, members], kind="stable")] if d[r, c] <= limit]
            assert cols[ends[i] - sizes[i] : ends[i]].tolist() == want


def test_drawn_numbers_are_never_null(spark):
    """Else a join on them brings a test for NULL, which moves down through all rounds and repeats them."""
    spec = Spec(E=(2,), L=(5,), samples=2, replacement=False)
    series = frame(spark, {"a": coupled(30)})
    drawn = draw_libraries(lengths(series, spec.pairs), spec)
    assert not drawn.schema["pos"].nullable
    joined = library_points(drawn, embed(series, spec.pairs))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "shiftright" in line]


def test_few_columns_are_the_nearest():
    """Ties go to the first column, infinite distances to none; what was measured stays as it is."""
    rng = np.random.default_rng(3)
    d = rng.integers(0, 6, (200, 40)).astype(float)
    d[rng.random(d.shape) < 0.2] = np.inf
    d[0], d[1, 1:] = np.inf, np.inf
    before = d.copy()
    order, near = tiles.nearest_columns(d, 3)
    assert (d == before).all()
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert (near == np.take_along_axis(d, want, 1)).all()
    held = np.isfinite(near)
    assert (order[held] == want[held]).all()


def test_whole_draws_rank_no_deeper_than_needed():
    held = np.ones((1, 50), np.int32)
    assert tiles.depth_for(held, 3) == 3
    assert tiles.depth_for(held, 3, ties=True) > 3


def test_points_are_packed_many_at_a_time(spark):
    """Not row by row in an aggregate's buffers; keys may be null, or come in no order."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(4), i, [float(i), None], rng.choice([None, 0.5])) for i in range(300)]
    packed = neighbors.pack(spark.createDataFrame(rows, "s string, b bigint, i bigint, v array<double>, y double").repartition(3), ["s", "b"], hits=True)
    got = {(r.s, r.b): sorted((p.i, p.v, p.y, p.hits) for p in r.points) for r in packed.collect()}
    assert len(got) == packed.count() == len({row[:2] for row in rows})
    for key, points in got.items():
        assert points == sorted((i, v, y, None) for s, b, i, v, y in rows if (s, b) == key)
    found = neighbours(frame(spark, {"a": coupled(60)}), Spec(E=(2,), L=(5,), strategy="library_first"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(collect_list(points" in plan
