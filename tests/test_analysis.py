import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelag.operators import (
    array_pearson, compare_skill, convergence, density, mean_at_max_l, pairwise_euclidean, pairwise_pearson, pivot_mean,
    rowwise_pearson, runtime_compare, runtime_totals, unpivot_mean,
)


def skill_frame(spark, rows):
    return spark.createDataFrame(
        [("a", E, 1, L, s, 10, rho, max(0.0, rho), 0.5) for E, L, s, rho in rows],
        "series_id string, E int, tau int, L int, sample int, n_pred bigint, rho double, rho_nonneg double, mae double",
    )


def test_convergence_and_largest_library(spark):
    skill = skill_frame(spark, [(2, 10, 0, -0.2), (2, 10, 1, 0.4), (2, 20, 0, 0.6), (2, 20, 1, -0.1), (3, 10, 0, 0.1)])
    rows = {(r.E, r.L): r for r in convergence(skill).collect()}
    assert rows[2, 10].mean_rho == pytest.approx(0.1) and rows[2, 10].std_rho == pytest.approx(0.3)
    assert rows[2, 10].mean_rho_nonneg == pytest.approx(0.2) and rows[2, 10].draws == 2
    best = {r.E: (r.L, r.mean_rho) for r in mean_at_max_l(skill).collect()}
    assert best[2] == (20, pytest.approx(0.3)) and best[3] == (10, pytest.approx(0.1))


def test_density(spark):
    rng = np.random.default_rng(0)
    rows = [(2, L, s, float(rng.uniform(-1, 1))) for L in (50, 70, 120, 170, 220) for s in range(40)]
    got = {(r.l_bin, r.value_bin): r.n for r in density(skill_frame(spark, rows)).collect()}
    step, lo, hi = 50, min(r[3] for r in rows), max(r[3] for r in rows)
    bins = 220 / step
    want = {}
    for _, L, _, rho in rows:
        at = min(math.floor((L - 50) / ((220 - 50) / bins)), math.ceil(bins) - 1)
        key = at, min(math.floor((rho - lo) / ((hi - lo) / 100)), 99)
        want[key] = want.get(key, 0) + 1
    assert got == want and sum(got.values()) == 200
    one = density(skill_frame(spark, [(2, 10, 0, 0.5)])).collect()
    assert [(r.l_bin, r.value_bin, r.n) for r in one] == [(0, 0, 1)]


def test_pivot_and_back(spark):
    means = spark.createDataFrame(
        [("a", w, E, w + E / 10) for w in (7, 14) for E in (2, 4)], "series_id string, width int, E int, mean_rho double"
    )
    wide = pivot_mean(means, (2, 4))
    assert sorted(map(tuple, wide.collect())) == [("a", 7, 7.2, 7.4), ("a", 14, 14.2, 14.4)]
    long = sorted((r.width, r.variable, r.value) for r in unpivot_mean(wide).collect())
    assert long == [(7, "E_2", 7.2), (7, "E_4", 7.4), (14, "E_2", 14.2), (14, "E_4", 14.4)]


def test_compare_keeps_one_sided_points(spark):
    a = skill_frame(spark, [(2, 10, 0, 0.2), (2, 10, 1, 0.4), (2, 20, 0, 0.5)])
    b = skill_frame(spark, [(2, 10, 0, 0.5), (2, 30, 0, 0.1)])
    rows = {r.L: (r.draws_a, r.mean_a, r.draws_b, r.mean_b, r.difference) for r in compare_skill(a, b).collect()}
    assert rows[10] == (2, pytest.approx(0.3), 1, 0.5, pytest.approx(0.2))
    assert rows[20] == (1, 0.5, None, None, None) and rows[30] == (None, None, 1, 0.1, None)


def test_run_times(spark):
    runs = spark.createDataFrame(
        [(100, 13.0, 22.0, 38.0, 61.0), (200, 142.0, 2.0, 38.0, 61.0)],
        "lib_size int, plain_query double, ranked_query double, plain_overhead double, ranked_overhead double",
    )
    table = runtime_compare(runs, "plain", "ranked")
    rows = {r.lib_size: r for r in table.collect()}
    assert rows[200].query_speedup == pytest.approx(71.0) and rows[100].total_speedup == pytest.approx(51 / 83)
    total = runtime_totals(table).first()
    assert (total.total_a, total.total_b) == (193.0, 85.0) and total.speedup == pytest.approx(193 / 85)


def test_vectors(spark, small_blocks):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 6))
    v[3] = 2.5
    df = spark.createDataFrame([(100 + 3 * i, [float(a) for a in row]) for i, row in enumerate(v)], "id bigint, vec array<double>")
    gap = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    with np.errstate(invalid="ignore"):
        corr = np.nan_to_num(np.corrcoef(v))
    for run, want in ((pairwise_euclidean, gap), (pairwise_pearson, corr)):
        cells = {((r.id - 100) // 3, (q - 100) // 3): d for r in run(df, "id", "vec").collect() for q, d in zip(r.q, r.d)}
        assert set(cells) == {(a, b) for a in range(40) for b in range(40) if a != b}
        assert max(abs(want[k] - d) for k, d in cells.items()) < 1e-12
        for r in run(df, "id", "vec", summarise=True).collect():
            others = np.delete(want[(r.id - 100) // 3], (r.id - 100) // 3)
            assert r.pairs == 39 and (r.mean, r.low, r.high) == pytest.approx((others.mean(), others.min(), others.max()), abs=1e-12)


def test_rowwise_pearson(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [1.0, 1.0, 1.0]), (3, [1.0, 2.0, 3.0])], "id int, vec array<double>")
    b = spark.createDataFrame([(1, [2.0, 1.0, 7.0]), (2, [5.0, 6.0, 7.0]), (4, [0.0, 0.0, 0.0])], "id int, vec array<double>")
    rows = {r.id: r.rho for r in rowwise_pearson(a, b, "id", "vec").collect()}
    assert rows == {1: pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 7])[0, 1]), 2: 0.0}
    far = spark.createDataFrame([(1, [1e9 + v for v in (1.0, 2.0, 4.0)], [1.0, 3.0, 2.0])], "id int, a array<double>, b array<double>")
    got = far.select(array_pearson(F.col("a"), F.col("b")).alias("r")).first().r
    assert got == pytest.approx(float(np.corrcoef([1, 2, 4], [1, 3, 2])[0, 1]), abs=1e-12)


def test_pair_summaries_in_few_blocks(spark, monkeypatch):
    """Summaries ship each block to a bounded number of others; near copies, missing numbers, repeated ids
    and values far from 0 keep their distances."""
    from tidelag.operators import neighbors, tiles

    rng = np.random.default_rng(8)
    v = rng.normal(size=(90, 5)) + 1000.0
    v[10] = v[3] + 1e-7
    v[11] = v[4]
    v[12, 2], v[13, 0] = np.nan, np.inf
    v[14] = 0.0
    ids = np.arange(90)
    ids[21] = 20
    units = []

    def counted(rows, *keys, deal=neighbors.deal_out):
        units.append(rows.count())
        return deal(rows, *keys)

    monkeypatch.setattr(neighbors, "POINTS", 7)
    monkeypatch.setattr(neighbors, "BLOCKS", "(n + 6) div 7")
    monkeypatch.setattr(neighbors, "SIDES", 4)
    monkeypatch.setattr(neighbors, "deal_out", counted)
    monkeypatch.setattr(tiles, "PART", (5, 9))
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id bigint, v array<double>")
    for measure, found in (("euclidean", pairwise_euclidean(df, "id", "v", True)), ("pearson", pairwise_pearson(df, "id", "v", True))):
        cells = tiles.distances(v, v) if measure == "euclidean" else tiles._standardised(v) @ tiles._standardised(v).T
        cells[(ids[:, None] == ids) | ~np.isfinite(cells)] = np.nan
        rows = {r.id: r for r in found.collect()}
        assert sorted(rows) == sorted(set(ids.tolist())) and units.pop() == 10
        for i, r in rows.items():
            mine = cells[ids == i]
            assert r.pairs == np.isfinite(mine).sum()
            if r.pairs:
                assert np.allclose([r.mean, r.low, r.high], [np.nanmean(mine), np.nanmin(mine), np.nanmax(mine)], rtol=1e-9, atol=1e-12)
            else:
                assert (r.mean, r.low, r.high) == (None, None, None)
