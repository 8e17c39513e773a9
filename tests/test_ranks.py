"""Stored rank tables: what is read equals what is measured."""

import math
import uuid

import pytest
from test_cross_map import OPTIONS, coupled, frame, mixed_series

from tidelag import Spec, cross_map, neighbours
from tidelag.operators import RankTable, embed, neighbors, rank_neighbors
from tidelag.staging import shared_folder


@pytest.fixture
def table(spark):
    made = []

    def make(depth, name=None):
        name = name or f"ranks_{uuid.uuid4().hex}"
        made.append(RankTable(spark, name, f"{shared_folder(spark)}/{name}", depth, buckets=4))
        return made[-1]

    yield make
    for one in made:
        one.drop()


def cut(series, n):
    return {name: (x[:n], y[:n]) for name, (x, y) in series.items()}


def rows_of(df):
    return sorted((*r[:5], r.n_pred, round(r.rho, 9), None if r.mae is None else round(r.mae, 9)) for r in df.collect())


@pytest.mark.parametrize("name,depth", [("default", 200), ("ties", 3), ("without replacement", 3), ("no zero", 3), ("distinct", 200)])
def test_skill_from_ranks(spark, table, name, depth):
    """Series that grow, and one that comes later; ranks too short for many draws, or whole."""
    series = mixed_series()
    series["long"] = coupled(90)
    spec = Spec(E=(1, 2), tau=(1,), L=(1, 4, 30), samples=3, **OPTIONS[name])
    ranks = table(depth)
    for n in (7, 1000):
        known = cut(series, n)
        if n == 7:
            del known["counts"]
        ranks.add(embed(frame(spark, known), spec.pairs))
    everything = frame(spark, series)
    assert rows_of(cross_map(everything, spec, ranks=ranks)) == rows_of(cross_map(everything, spec))
    # nothing new: nothing is added
    before = ranks.rows().count()
    ranks.add(embed(everything, spec.pairs))
    assert ranks.rows().count() == before


def test_missing_coordinates(spark, table):
    x = [None if i % 7 == 3 else float(i * i % 23) for i in range(60)]
    series = frame(spark, {"a": (x, [float(i % 5) for i in range(60)])})
    spec, ranks = Spec(E=(2,), L=(10,), samples=4), table(100)
    ranks.add(embed(series, spec.pairs))
    assert rows_of(cross_map(series, spec, ranks=ranks)) == rows_of(cross_map(series, spec))
    with pytest.raises(ValueError):
        neighbours(series, Spec(E=(2,), drop_missing=True), ranks=ranks)
    with pytest.raises(Exception, match="vectors were dropped"):
        table(5).add(embed(series, spec.pairs, drop_missing=True))


def test_a_second_run_measures_nothing(spark, table, monkeypatch):
    """Read again under the same name, the table answers without a meeting of blocks, and its own
    side of the plan has no exchange."""
    series = frame(spark, {"a": coupled(80)})
    spec, ranks = Spec(E=(2,), L=(40,), samples=3), table(79)
    ranks.add(embed(series, spec.pairs))
    again = table(79, ranks.name)
    monkeypatch.setattr(neighbors, "_rank_units", lambda *a: pytest.fail("distances were measured"))
    assert neighbours(series, spec, ranks=again).count() == 3 * 79
    plan = again.points()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


@pytest.mark.parametrize("no_zero", [False, True])
def test_copies_are_told_apart_by_hash(spark, small_blocks, no_zero):
    """Many copies of one vector, with 0 and -0 for the same number; those that go into no box are
    found without taking all others away from all points."""
    x = [0.0, -0.0, 1.0, 2.0] * 20 + [float(i * i % 31) for i in range(60)]
    points = embed(frame(spark, {"a": (x, x)}), [(2, 1)])
    ranked = rank_neighbors(points, 2, exclude_zero_distance=no_zero)
    got = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.p, r.r)):
        got.setdefault(r.p, []).append((r.d, r.q))
    at = {i: (x[i], x[i - 1]) for i in range(1, len(x))}
    for p, v in at.items():
        every = sorted((math.dist(v, w), q) for q, w in at.items() if q != p)
        want = [(d, q) for d, q in every if d > 0 or not no_zero][:2]
        assert [q for _, q in got[p]] == [q for _, q in want] and [d for d, _ in got[p]] == pytest.approx([d for d, _ in want])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
