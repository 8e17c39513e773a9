import random

import pytest
from pyspark.sql import functions as F

from tidelag import LengthRange, Spec, cross_map, param_values, scenario_sweep, stage, validate_grid
from tidelag.operators import accumulate_vs_next, argsort, embed, lengths, library_grid, rolling_sum
from tidelag.operators.ordering import dense_rank_of
from tidelag.sources import (
    bin_rows,
    make_series, read_series_csv, read_skill, read_tasks_json, require_paired, skill_to_json, write_skill,
)


def counts_frame(spark, values, name="a"):
    return spark.createDataFrame([(name, i, v, v) for i, v in enumerate(values)], "series_id string, i bigint, x double, y double")


def test_csv_by_header_name(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(", up,Down Count\n0,1,9\n2,3.5,text\n1,2,\n3,nan,6\n")
    rows = read_series_csv(spark, str(path), "up", "Down Count", order_by="_c0").orderBy("i").collect()
    assert [(r.i, r.x, r.y) for r in rows] == [(0, 1.0, 9.0), (1, 2.0, None), (2, 3.5, None), (3, None, 6.0)]
    assert {(r.series_id, r.n) for r in rows} == {("all", 4)}
    in_file_order = read_series_csv(spark, str(path), "up", "Down Count").orderBy("i").collect()
    assert [r.x for r in in_file_order] == [1.0, 3.5, 2.0, None]
    with pytest.raises(ValueError, match="not in"):
        read_series_csv(spark, str(path), "up", "missing")


def test_make_series_fills_the_calendar(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01 00:30:00", 1.5), ("a", "2024-01-01 00:45:00", 2.0), ("a", "2024-01-01 03:00:00", None),
         ("b", "1969-12-31 22:10:00", 4.0)],
        "k string, t string, v double",
    ).select("k", F.col("t").cast("timestamp_ntz").alias("t"), "v")

    def series(**o):
        out = make_series(rows, "t", F.col("v"), F.col("v") * 2, "hour", F.col("k"), **o).orderBy("series_id", "i")
        return [(r.series_id, r.n, r.i, r.x, r.y) for r in out.collect()]

    assert series() == [
        ("a", 4, 0, 3.5, 7.0), ("a", 4, 1, 0.0, 0.0), ("a", 4, 2, 0.0, 0.0), ("a", 4, 3, 0.0, 0.0), ("b", 1, 0, 4.0, 8.0),
    ]
    assert [r[3] for r in series(how="avg", fill=None)] == [1.75, None, None, None, 4.0]
    assert [r[3] for r in series(how="count")] == [2.0, 0.0, 0.0, 0.0, 1.0]
    wide = series(bounds=("2023-12-31 23:00:00", "2024-01-01 04:00:00"))
    assert [r[3] for r in wide if r[0] == "a"] == [0.0, 3.5, 0.0, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        series(how="median")


def test_grid_values():
    assert param_values(100, 800, 100)[-1] == 800
    assert param_values(10, 35, 10) == (10, 20, 30)
    for bad in [dict(E=(0,)), dict(tau=(-1,)), dict(L=()), dict(samples=0), dict(ties="some"), dict(strategy="x"),
                dict(weight_floor=-1.0), dict(E=(1.5,)), dict(L=LengthRange(0, 5))]:
        with pytest.raises(ValueError):
            Spec(**bad)
    with pytest.raises(ValueError):
        validate_grid([1], [1], [1], True)


def test_grid_has_one_row_per_point(spark):
    series = counts_frame(spark, [float(v) for v in range(50)])
    for strategy in ("shared", "library_first"):
        spec = Spec(E=(1, 3), tau=(2,), L=(5, 900), samples=300, strategy=strategy)
        rows = library_grid(lengths(series, spec.pairs), spec).collect()
        want = [(E, L, n, min(L, n)) for E, n in ((1, 50), (3, 46)) for L in (5, 900)]
        assert sorted((r.E, r.L, r.n, r.size) for r in rows) == want


def test_sums_keep_what_values_say(spark):
    rows = [(0, 1e-7), (0, 3e-7), (1, 0.1234567), (2, float("nan")), (3, float("inf")), (3, 2.0), (5, 1e19), (6, None)]
    df = spark.createDataFrame(rows, "h int, v double").selectExpr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, h) AS ts", "v")
    series = make_series(df, "ts", F.col("v"), F.col("v"))
    got = [r.x for r in series.orderBy("i").collect()]
    assert got == [pytest.approx(4e-7), 0.1234567, None, 2.0, 0.0, 1e19, 0.0]
    exact = make_series(df.where("v >= 2 AND v < 1e9"), "ts", F.col("v"), F.col("v"), decimals=2)
    assert [r.x for r in exact.collect()] == [2.0]
    for bad in (0.1234567, 1e-7, 1e23):
        odd = spark.createDataFrame([(bad,)], "v double").selectExpr("timestamp_ntz'2024-01-01' AS ts", "v")
        with pytest.raises(Exception, match="does not fit"):
            bin_rows(odd, "ts", F.col("v"), F.col("v"), decimals=2).collect()


def test_csv_files_in_the_order_of_their_names(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("x,y,d\n1,1,2024-01-03\n2,2,2024-01-01\n")
    (tmp_path / "part-1.csv").write_text("x,y,d\n" + "".join(f"{i},{i},2024-02-0{i}\n" for i in range(3, 9)))
    got = read_series_csv(spark, str(tmp_path), "x", "y").orderBy("i").collect()
    assert [r.x for r in got] == [float(i) for i in range(1, 9)] and {r.n for r in got} == {8}
    by_date = read_series_csv(spark, str(tmp_path), "x", "y", "d").orderBy("i").collect()
    assert [r.x for r in by_date] == [2.0, 1.0, *[float(i) for i in range(3, 9)]]
    (tmp_path / "part-2.csv").write_text("x,y,d\n9,9,soon\n")
    with pytest.raises(Exception, match="neither number nor time"):
        read_series_csv(spark, str(tmp_path), "x", "y", "d")


def test_large_whole_numbers_stay_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"x,y,k\n2,0,{2**53 + 2}\n1,0,{2**53 + 1}\n0,0,{2**53}\n")
    assert [r.x for r in read_series_csv(spark, str(tmp_path), "x", "y", "k").orderBy("i").collect()] == [0.0, 1.0, 2.0]


def test_require_paired(spark):
    good = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, None, None)], "series_id string, i bigint, x double, y double")
    assert require_paired(good).count() == 2
    with pytest.raises(Exception, match="unpaired value in series a at 0"):
        require_paired(good.withColumn("x", F.lit(None).cast("double"))).collect()


@pytest.mark.parametrize("stretch", [3, 5, 1 << 18])
def test_windows_over_stretches(spark, stretch):
    rng = random.Random(stretch)
    values = [float(rng.randrange(9)) for _ in range(40)]
    df = counts_frame(spark, values)
    points = embed(df, [(3, 2), (1, 1)], stretch=stretch).orderBy("E", "i").collect()
    assert [(r.i, r.v) for r in points if r.E == 1] == [(i, [v]) for i, v in enumerate(values)]
    assert [(r.i, r.pos, r.v) for r in points if r.E == 3] == [
        (i, i - 4, [values[i], values[i - 2], values[i - 4]]) for i in range(4, 40)
    ]
    sums = rolling_sum(df, "x", 6, stretch=stretch).orderBy("i").collect()
    assert [(r.i, r.rolling_sum) for r in sums] == [(i, sum(values[i - 5 : i + 1])) for i in range(5, 40)]
    pairs = accumulate_vs_next(df, "x", (4, 7), (2, 3), stretch=stretch).orderBy("i").collect()
    for w in (4, 7):
        for a in (2, 3):
            # Sums of all full windows without the last ``a``, counts without the first w+a-1.
            x = [sum(values[t - w : t]) for t in range(w, 41)][:-a]
            y = values[w + a - 1 :]
            got = [r for r in pairs if (r.width, r.ahead) == (w, a)]
            assert [(r.i, r.x, r.y) for r in got] == [(i, *v) for i, v in enumerate(zip(x, y, strict=True))]
            assert {r.n for r in got} == {len(x)}


def test_dense_rank_with_hot_values(spark):
    rng = random.Random(1)
    rows = [("hot", 5.0, t) for t in range(40)]
    rows += [("hot", rng.choice([float("nan"), None, float("inf"), -3.0, 5.0, 5.5, rng.random()]), t) for t in range(40, 90)]
    rows += [(None, float(t % 4), t) for t in range(15)]
    rows += [("big", float(2**53 + rng.randrange(4)), t) for t in range(20)]
    df = spark.createDataFrame(rows, "k string, v double, t bigint")
    got = {(r.k, r.t): r.rank for r in argsort(df, ["k"], "v", "t").collect()}
    order = {}
    for k in ("hot", "big", None):
        group = sorted(
            (r for r in rows if r[0] == k),
            key=lambda r: (r[1] is not None, r[1] is not None and r[1] != r[1], r[1] if r[1] == r[1] and r[1] is not None else 0, r[2]),
        )
        order |= {(k, t): rank for rank, (_, _, t) in enumerate(group)}
    assert got == order


def test_dense_rank_of_long_whole_numbers(spark):
    rows = [(2**60 + (7 * t) % 5, t) for t in range(30)]
    df = spark.createDataFrame([("a", *r) for r in rows], "k string, v bigint, t bigint")
    got = sorted((r.i, r.v, r.t) for r in dense_rank_of(df, ["k"], "v", "t").collect())
    assert got == [(i, *r) for i, r in enumerate(sorted(rows))]


def test_results_on_disk(spark, tmp_path):
    series = counts_frame(spark, [float((7 * v) % 11) for v in range(40)])
    skill = cross_map(series, Spec(E=(2, 3), tau=(1,), L=(5, 10), samples=3)).cache()
    want = sorted((r.E, r.tau, r.L, round(r.rho, 9)) for r in skill.collect())
    for fmt in ("csv", "parquet"):
        write_skill(skill, str(tmp_path / fmt), fmt)
        assert (tmp_path / fmt / "E=2" / "tau=1").is_dir()
        back = read_skill(spark, str(tmp_path / fmt), fmt).collect()
        assert sorted((r.E, r.tau, r.lib_size, round(r.rho, 9)) for r in back) == want
    with pytest.raises(ValueError):
        write_skill(skill, str(tmp_path / "x"), "xlsx")
    plain = tmp_path / "plain.csv"
    plain.write_text("E, tau, L, rho\n2, 1, 100, 0.5\n2, 1, 200, -0.25\n")
    assert [tuple(r) for r in read_skill(spark, str(plain)).orderBy("lib_size").collect()] == [(2, 1, 100, 0.5), (2, 1, 200, -0.25)]
    lines = skill_to_json(skill, 3).where("E = 2 AND L = 5").collect()
    result = ",".join(f"{r.rho:.3f}" for r in sorted(skill.where("E = 2 AND L = 5").collect(), key=lambda r: r.sample))
    assert [r.json for r in lines] == ['{"e":2,"tau":1,"l":5,"result":[' + result + "]}"]


def test_json_tasks(spark, tmp_path):
    path = tmp_path / "tasks.json"
    path.write_text(
        '{"observations": [1, 2, 3], "targets": [4, 5, 6], "e": 2, "tau": 1, "l": 10, "samples": 5, "multil": 0, "genoutput": 0}\n'
        '{"observations": [1, 2, 3], "targets": [4, 5, 6], "e": 3, "tau": 1, "samples": 5, "multil": 1, "lstart": 10, '
        '"lend": 30, "linterval": 10, "genoutput": 1, "gpu": 0, "outputpath": "/out"}\n'
    )
    series, tasks = read_tasks_json(spark, str(path))
    assert sorted((r.n, r.i, r.x, r.y) for r in series.collect()) == [(3, 0, 1.0, 4.0), (3, 1, 2.0, 5.0), (3, 2, 3.0, 6.0)]
    assert sorted((r.E, r.tau, r.L, r.samples) for r in tasks.collect()) == [(2, 1, 10, 5), (3, 1, 10, 5), (3, 1, 20, 5), (3, 1, 30, 5)]
    path.write_text('{"observations": [1, 2, 3], "targets": [4, 5], "e": 2, "tau": 1, "l": 10, "samples": 5, "multil": 0}\n')
    with pytest.raises(Exception, match="differ in length"):
        read_tasks_json(spark, str(path))[0].collect()


def test_scenarios_equal_single_runs(spark):
    rng = random.Random(4)
    df = counts_frame(spark, [float(rng.randrange(4)) for _ in range(80)])
    spec = Spec(tau=(1,), L=LengthRange(20, 25), samples=2)
    got = scenario_sweep(df, "x", (2, 3), (3, 9), spec).collect()
    assert {(r.width, r.E, r.L) for r in got} == {(w, E, L) for w in (3, 9) for E in (2, 3) for L in (20, 45, 70) if L <= 81 - w - E}
    pair = accumulate_vs_next(df, "x", (9,), (3,)).withColumn("series_id", F.lit("a|9"))
    want = cross_map(pair.select("series_id", "i", "x", "y"), Spec(E=(3,), tau=(1,), L=(20, 45), samples=2)).collect()
    for r in want:
        match = [g.rho for g in got if (g.width, g.E, g.L, g.sample) == (9, 3, r.L, r.sample)]
        assert match == [pytest.approx(r.rho, abs=1e-12)]


def test_staging_keeps_rows(spark):
    df = counts_frame(spark, [1.0, 2.0, 3.0])
    assert sorted(stage(df).collect()) == sorted(df.collect())


def test_trailing_sums_of_any_width(spark):
    """Widths over several stretches, with missing values; exact where values have decimals."""
    rng = __import__("random").Random(4)
    values = [rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.3 else rng.randrange(-10**9, 10**9) / 100 for _ in range(400)]
    values[100:180] = [None] * 80
    rows = [("a", i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, i bigint, x double")
    cents = [None if v is None or v != v or abs(v) == float("inf") else round(v * 100) for v in values]
    for width in (1, 5, 70, 399):
        want = {}
        for i in range(width - 1, 400):
            held = [c for c in cents[i - width + 1 : i + 1] if c is not None]
            want[i] = sum(held) / 100 if held else None
        exact = {r.i: r.rolling_sum for r in rolling_sum(df, "x", width, stretch=64, decimals=2).collect()}
        assert exact == want
        near = {r.i: r.rolling_sum for r in rolling_sum(df, "x", width, stretch=64).collect()}
        assert set(near) == set(want)
        for i, v in want.items():
            assert (near[i] is None) == (v is None) and (v is None or near[i] == pytest.approx(v, abs=1e-4))
    whole = spark.createDataFrame([("a", i, i) for i in range(50)], "series_id string, i bigint, x bigint")
    assert [r.rolling_sum for r in rolling_sum(whole, "x", 10, stretch=8).orderBy("i").collect()] == [sum(range(i - 9, i + 1)) for i in range(9, 50)]
    with pytest.raises(Exception, match="does not fit 1 decimals"):
        rolling_sum(df, "x", 5, decimals=1).collect()


def test_a_width_of_100000(spark):
    """One pass whatever the width; the sums of two ends and their number."""
    df = spark.range(300_000).selectExpr("'a' AS series_id", "id AS i", "CAST(id % 1000 AS DOUBLE) / 4 AS x")
    got = rolling_sum(df, "x", 100_000, decimals=2).selectExpr("min(i)", "max(i)", "count(*)", "min(rolling_sum)", "max(rolling_sum)").first()
    assert tuple(got) == (99_999, 299_999, 200_001, 12_487_500.0, 12_487_500.0)


def test_task_results_go_where_the_task_says(spark, tmp_path):
    import json

    from tidelag import Spec, cross_map
    from tidelag.sources import read_task_results, write_task_results

    base = {"observations": [float(i * i % 7) for i in range(20)], "targets": [float(i % 5) for i in range(20)], "tau": 1, "l": 6, "multil": 0, "gpu": 0,
            "lstart": 4, "lend": 8, "linterval": 4}
    tasks = [
        {**base, "name": "a", "e": 2, "samples": 3, "genoutput": 1, "outputpath": "here/x"},
        {**base, "name": "a", "e": 2, "samples": 2, "genoutput": 1, "outputpath": "there"},
        {**base, "name": "b", "e": 3, "samples": 2, "genoutput": 1, "outputpath": "here/x", "multil": 1},
        {**base, "name": "a", "e": 3, "samples": 5, "genoutput": 0, "outputpath": "here/x"},
    ]
    (tmp_path / "tasks.json").write_text("\n".join(map(json.dumps, tasks)))
    series, found = read_tasks_json(spark, str(tmp_path / "tasks.json"))
    skill = cross_map(series, Spec(), found)
    for fmt in ("csv", "parquet"):
        write_task_results(skill, found, str(tmp_path / fmt), fmt)
        got = read_task_results(spark, str(tmp_path / fmt), fmt)
        keys = sorted((r.outputpath, r.series_id, r.E, r.L, r.sample) for r in got.collect())
        want = [("here/x", "a", 2, 6, s) for s in range(3)] + [("there", "a", 2, 6, s) for s in range(2)]
        want += [("here/x", "b", 3, L, s) for L in (4, 8) for s in range(2)]
        assert keys == sorted(want)
        rho = {(r.series_id, r.E, r.L, r.sample): r.rho for r in skill.collect()}
        assert all(r.rho == rho[r.series_id, r.E, r.L, r.sample] for r in got.collect())
    other = {**base, "name": "a", "e": 2, "samples": 1, "targets": [1.0] * 20}
    (tmp_path / "clash.json").write_text("\n".join(map(json.dumps, [tasks[0], other])))
    with pytest.raises(Exception, match="one name for different series"):
        read_tasks_json(spark, str(tmp_path / "clash.json"))[0].collect()
