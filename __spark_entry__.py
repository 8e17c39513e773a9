"""Queries of the engine on the given tables, with equal SQL for each."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles as sql  # noqa: E402
from tidelag import LengthRange, Spec, cross_map, forecasts, neighbours, param_values, scenario_sweep, stage  # noqa: E402
from tidelag import operators as op  # noqa: E402
from tidelag.plans import manifold_of  # noqa: E402
from tidelag.sources import (  # noqa: E402
    bin_rows, fill_calendar, read_series_csv, read_skill, read_task_results, read_tasks_json, require_paired, skill_to_json, write_skill,
    write_task_results,
)
from tidelag.staging import shared_folder  # noqa: E402

_here = os.path.dirname(os.path.abspath(__file__))
llm = None
if os.path.exists(os.path.join(_here, "corpus_pipeline.py")) and os.path.exists(os.path.join(_here, "tidelag", "llm", "queries.py")):
    from tidelag.llm import queries as llm  # noqa: E402  # the subpackage is optional


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _clicks_and_views(spark, sf_dir, every="hour", series_id=None, how="sum", fill=0.0) -> DataFrame:
    """Click value against view value per step; values have two decimals."""
    events = _table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    x, y = (F.when(F.col("event_type") == kind, F.col("value")) for kind in ("click", "view"))
    return _series(bin_rows(events, "ts", x, y, every, series_id, how, decimals=2), fill)


def _users(spark, sf_dir) -> DataFrame:
    """One daily series per user."""
    return _clicks_and_views(spark, sf_dir, "day", F.col("user_id").cast("string"))


def _event_counts(spark, sf_dir) -> DataFrame:
    """Whole numbers with many ties."""
    return _series(bin_rows(_table(spark, sf_dir, "events"), "ts", F.lit(1), F.lit(1), "hour", how="count"))


def _daily_orders(spark, sf_dir) -> DataFrame:
    return _series(bin_rows(_table(spark, sf_dir, "orders"), "o_orderdate", F.lit(1), F.lit(1), "day", how="count"))


def _series(binned: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Binned rows are few; staged, the raw table is scanned once whatever is built on them."""
    return fill_calendar(stage(binned), fill)


def _tidy(df: DataFrame, *numbers: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in numbers})


def _skill(df: DataFrame) -> DataFrame:
    return _tidy(df, "rho", "rho_nonneg", "mae")


def _vector(df: DataFrame, E: int) -> DataFrame:
    return df.select("series_id", "E", "tau", "i", "pos", *[F.col("v")[j].alias(f"x{j}") for j in range(E)], "y")


SINGLE = Spec(E=(3,), tau=(1,), L=(200,), samples=5)
MULTI = Spec(E=(3,), tau=(1,), L=param_values(100, 400, 100), samples=5)
SWEEP = Spec(E=(2, 3), tau=(1, 2), L=param_values(100, 300, 100), samples=4)
TIES = Spec(E=(2,), tau=(1,), L=(150,), samples=3, ties="include")
USERS = Spec(E=(2, 3), tau=(1,), L=(5, 15, 40), samples=3)
LONG = Spec(E=(2,), tau=(1,), L=(500,), samples=2)
SPARSE = Spec(E=(2,), tau=(1,), L=(200,), samples=2)
SCENARIO = Spec(tau=(1,), L=LengthRange(50, 200), samples=2)
SCENARIO_E, SCENARIO_WIDTHS = (2, 4), (7, 14, 30)


def _libraries(series: DataFrame, spec: Spec) -> DataFrame:
    points, sizes = manifold_of(series, spec)
    return op.library_points(op.draw_libraries(sizes, spec), points)


def _ranks(series: DataFrame, pair: tuple[int, int], k: int, **options) -> DataFrame:
    return _tidy(op.rank_neighbors(op.embed(series, [pair]), k, sizes=op.lengths(series, [pair]), **options), "d")


def _knn_rows(series: DataFrame, spec: Spec, library: DataFrame | None = None) -> DataFrame:
    rows = op.explode_neighbors(neighbours(series, spec, library=library))
    return _tidy(rows.select("series_id", "E", "tau", "L", "sample", "p", "r", "q", "d", "m"), "d")


def _weight_rows(series: DataFrame, spec: Spec) -> DataFrame:
    found = op.simplex_weights(neighbours(series, spec), spec.weight_floor, spec.ties)
    rows = found.select("series_id", "E", "tau", "L", "sample", "p", F.inline(F.arrays_zip("q", "m", "w")))
    return _tidy(rows, "w")


def _scenario(spark, sf_dir) -> DataFrame:
    return scenario_sweep(_event_counts(spark, sf_dir), "x", SCENARIO_E, SCENARIO_WIDTHS, SCENARIO, decimals=0)


def _scenario_means(spark, sf_dir) -> DataFrame:
    return op.mean_at_max_l(_scenario(spark, sf_dir), ("series_id", "width", "E"))


def _all_events(spark, sf_dir) -> DataFrame:
    """Every event as one step, in the order of event_id: value against user_id."""
    events = _table(spark, sf_dir, "events")
    rows = events.selectExpr("event_id", "CAST(value AS DOUBLE) AS x", "CAST(user_id AS DOUBLE) AS y")
    return op.dense_rank_of(rows, [], "event_id", "event_id", total="n").selectExpr("'all' AS series_id", "n", "i", "x", "y")


def _line_items(spark, sf_dir) -> DataFrame:
    """Lineitem in the order of its key (which is not unique; then of its values) as one series:
    price against quantity."""
    items = _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "struct(l_linenumber, l_extendedprice, l_quantity) AS line", "CAST(l_extendedprice AS DOUBLE) AS x", "CAST(l_quantity AS DOUBLE) AS y"
    )
    return op.dense_rank_of(items, [], "l_orderkey", "line", total="n").selectExpr("'all' AS series_id", "n", "i", "x", "y")


def _purchase_hours(spark, sf_dir) -> DataFrame:
    """A library chosen by a rule: the hours with purchases, each as often as it has any, in one
    draw for even and one for odd user numbers. Hours count from the first click or view."""
    hour = "unix_timestamp(ts) div 3600"
    events = _table(spark, sf_dir, "events")
    first = events.where("event_type IN ('click', 'view')").agg(F.expr(f"min({hour}) AS first"))
    bought = events.where("event_type = 'purchase'").crossJoin(F.broadcast(first))
    rows = bought.selectExpr("CAST(user_id % 2 AS INT) AS sample", f"{hour} - first AS idx")
    return rows.groupBy("sample", "idx").agg(F.count("*").alias("m")).selectExpr(
        "'all' AS series_id", "3 AS E", "1 AS tau", "1 AS L", "sample", "idx", "m"
    )


def _task_runs(spark, sf_dir) -> DataFrame:
    """Tasks as JSON lines, each with its own E, tau, L and samples: one per user group, over
    the daily values of its clicks and views; written, read back and run. Results go to the
    output path that each task names, and are read from there."""
    users = _clicks_and_views(spark, sf_dir, "day", F.expr("CAST(user_id % 4 AS STRING)"))
    packed = users.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("r"))
    group = F.col("series_id").cast("int")
    lines = packed.select(
        F.col("series_id").alias("name"), F.col("r.x").alias("observations"), F.col("r.y").alias("targets"),
        (group % 2 + 2).alias("e"), (group % 3 + 1).alias("tau"),
        F.lit(10).alias("l"), (group + 1).alias("samples"), F.when(group > 1, 1).otherwise(0).alias("multil"),
        F.lit(5).alias("lstart"), F.lit(15).alias("lend"), F.lit(5).alias("linterval"),
        F.when(group == 0, 0).otherwise(1).alias("genoutput"), F.concat(F.lit("groups/odd="), group % 2).alias("outputpath"),
    )
    folder = f"{shared_folder(spark)}/tasks-{uuid.uuid4().hex}"
    lines.write.json(f"{folder}/in")
    series, tasks = read_tasks_json(spark, f"{folder}/in")
    write_task_results(cross_map(series, Spec(seed=42), tasks), tasks, f"{folder}/out")
    return _skill(read_task_results(spark, f"{folder}/out"))


def _csv_series(spark, sf_dir) -> DataFrame:
    """Orders to CSV files and back as a series ordered by key."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    orders = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_totalprice AS DOUBLE) AS price", "o_custkey")
    orders.write.option("header", True).csv(path)
    return read_series_csv(spark, path, "price", "o_custkey", "o_orderkey")


def _stored_skill(spark, sf_dir) -> DataFrame:
    """Skill rows written by (E, tau) and read back."""
    path = f"{shared_folder(spark)}/skill-{uuid.uuid4().hex}"
    write_skill(_skill(cross_map(_clicks_and_views(spark, sf_dir), SWEEP)), path, "csv")
    return read_skill(spark, path, "csv")


def _skill_from_ranks(spark, sf_dir) -> DataFrame:
    """Ranks of the first half of the series are stored, then those of the rest are added; runs of
    several library sizes read them."""
    series = _clicks_and_views(spark, sf_dir)
    name = f"ranks_{uuid.uuid4().hex}"
    table = op.RankTable(spark, name, f"{shared_folder(spark)}/{name}", depth=96)
    half = series.where("i < n div 2").withColumn("n", F.expr("n div 2"))
    for known in (half, series):
        table.add(op.embed(known, MULTI.pairs))
    runs = stage(_skill(cross_map(series, MULTI, ranks=table)))
    table.drop()
    return runs


def _priority_times(spark, sf_dir) -> DataFrame:
    """Two costs per order priority, compared as run times are."""
    runs = _table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.expr("CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)").alias("a_query"),
        F.expr("CAST(count(*) AS DOUBLE)").alias("a_overhead"),
        F.expr("CAST(sum(o_custkey) AS DOUBLE)").alias("b_query"), F.lit(1.0).alias("b_overhead"),
    )
    compared = op.runtime_compare(runs, "a", "b", "o_orderpriority")
    return _tidy(compared, *[c for c in compared.columns if c != "o_orderpriority"])


def _without(spec: Spec) -> Spec:
    return Spec(E=spec.E, tau=spec.tau, L=spec.L, samples=spec.samples, replacement=False)


def _next_vector(vectors: DataFrame) -> DataFrame:
    return vectors.select((F.col("vec_id") - 1).alias("vec_id"), "embedding")


def entry(spark: SparkSession) -> DataFrame:
    return queries()["xmap_single"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _series_queries() | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return {name: text.replace("WITH ", "WITH RECURSIVE ", 1) for name, text in _series_sql().items()} | (llm.oracle_sql() if llm else {})


def _series_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    hourly = _clicks_and_views
    return {
        # Series
        "series_hourly_events": lambda s, d: hourly(s, d),
        "series_daily_orders": lambda s, d: _daily_orders(s, d),
        "series_daily_users": lambda s, d: _users(s, d),
        "param_grid": lambda s, d: op.library_grid(op.lengths(_users(s, d), USERS.pairs), USERS).select(
            "series_id", "E", "tau", "n", "L", "size"
        ),
        "skill_json": lambda s, d: skill_to_json(cross_map(hourly(s, d), MULTI), 6),
        # Shaping
        "embed_e3_tau1": lambda s, d: _vector(op.embed(hourly(s, d), [(3, 1)]), 3),
        "embed_e2_tau2": lambda s, d: _vector(op.embed(_users(s, d), [(2, 2)]), 2),
        "embed_drop_missing": lambda s, d: _tidy(
            _vector(op.embed(hourly(s, d, how="avg", fill=None), [(3, 1)], drop_missing=True), 3), "x0", "x1", "x2", "y"
        ),
        "rolling_sum_w7": lambda s, d: op.rolling_sum(_daily_orders(s, d), "x", 7, decimals=0).select(
            "series_id", "i", "x", "rolling_sum"
        ),
        "rolling_sum_w10000": lambda s, d: op.rolling_sum(_line_items(s, d), "x", 10_000, decimals=2).select("series_id", "i", "rolling_sum"),
        "accumulate_vs_next": lambda s, d: op.accumulate_vs_next(_daily_orders(s, d), "x", (7, 14), (2, 4), decimals=0),
        # Distances and neighbours
        "pair_distances": lambda s, d: _tidy(
            op.pair_distances(op.embed(hourly(s, d), [(3, 1)]), summarise=True).select(
                "series_id", "E", "tau", "p", "pairs", F.try_divide("total", "pairs").alias("mean"), "low", "high"
            ),
            "mean", "low", "high",
        ),
        "rank_neighbors_k10": lambda s, d: _ranks(hourly(s, d), (3, 1), 10),
        "knn_exclude_zero": lambda s, d: _ranks(_daily_orders(s, d), (2, 1), 5, exclude_zero_distance=True),
        "knn_library": lambda s, d: _knn_rows(hourly(s, d), SINGLE),
        "knn_library_first": lambda s, d: _knn_rows(hourly(s, d), Spec(samples=5, strategy="library_first")),
        "knn_library_distinct": lambda s, d: _knn_rows(hourly(s, d), Spec(samples=5, distinct_library=True)),
        "knn_library_no_zero": lambda s, d: _knn_rows(
            _event_counts(s, d), Spec(E=(2,), L=(150,), samples=3, exclude_zero_distance=True)
        ),
        "knn_given_library": lambda s, d: _knn_rows(hourly(s, d), SINGLE, _purchase_hours(s, d)),
        "knn_with_ties": lambda s, d: _knn_rows(_event_counts(s, d), TIES),
        # Libraries
        "library_with_replacement": lambda s, d: _libraries(hourly(s, d), SINGLE),
        "library_without_replacement": lambda s, d: _libraries(hourly(s, d), _without(SINGLE)),
        "library_clamped": lambda s, d: _libraries(_users(s, d), _without(USERS)),
        # Forecasts and skill
        "simplex_weights": lambda s, d: _weight_rows(hourly(s, d), SINGLE),
        "simplex_weights_ties": lambda s, d: _weight_rows(_event_counts(s, d), TIES),
        "simplex_predict": lambda s, d: _tidy(forecasts(hourly(s, d), SINGLE), "y_hat"),
        "skill_rho": lambda s, d: _skill(cross_map(hourly(s, d), SINGLE)).select(
            "series_id", "E", "tau", "L", "sample", "n_pred", "rho"
        ),
        "skill_rho_nonneg": lambda s, d: _skill(cross_map(hourly(s, d), MULTI)).select(
            "series_id", "E", "tau", "L", "sample", "rho_nonneg"
        ),
        "skill_mae": lambda s, d: _skill(cross_map(hourly(s, d), MULTI)).select(
            "series_id", "E", "tau", "L", "sample", "mae"
        ),
        # Whole runs
        "xmap_single": lambda s, d: _skill(cross_map(hourly(s, d), SINGLE)),
        "xmap_multi_l": lambda s, d: _skill(cross_map(hourly(s, d), MULTI)),
        "xmap_sweep": lambda s, d: _skill(cross_map(hourly(s, d), SWEEP)),
        "xmap_without_replacement": lambda s, d: _skill(cross_map(hourly(s, d), _without(MULTI))),
        "xmap_ties": lambda s, d: _skill(cross_map(_event_counts(s, d), TIES)),
        "xmap_by_user": lambda s, d: _skill(cross_map(_users(s, d), USERS)),
        "scenario_sweep": lambda s, d: _skill(_scenario(s, d)),
        # Analysis
        "convergence_curve": lambda s, d: _tidy(
            op.convergence(cross_map(hourly(s, d), SWEEP)), "mean_rho", "std_rho", "mean_rho_nonneg", "mean_mae"
        ),
        "mean_rho_at_max_l": lambda s, d: _tidy(op.mean_at_max_l(cross_map(_users(s, d), USERS)), "mean_rho"),
        "rho_density": lambda s, d: op.density(_skill(cross_map(hourly(s, d), SWEEP))),
        "scenario_pivot": lambda s, d: _tidy(op.pivot_mean(_scenario_means(s, d), SCENARIO_E), "E_2", "E_4"),
        "scenario_unpivot": lambda s, d: _tidy(op.unpivot_mean(op.pivot_mean(_scenario_means(s, d), SCENARIO_E)), "value"),
        "compare_skill": lambda s, d: _tidy(
            op.compare_skill(*[cross_map(series, spec) for series in [hourly(s, d)] for spec in (MULTI, _without(MULTI))]),
            "mean_a", "mean_b", "difference",
        ),
        "xmap_tasks": lambda s, d: _task_runs(s, d),
        "series_csv": lambda s, d: _csv_series(s, d),
        "series_paired": lambda s, d: require_paired(_users(s, d)),
        "skill_stored": lambda s, d: _stored_skill(s, d),
        "runtime_compare": lambda s, d: _priority_times(s, d),
        # One series of all events
        "rank_neighbors_long": lambda s, d: _ranks(_all_events(s, d), (2, 1), 3),
        "knn_library_long": lambda s, d: _knn_rows(_all_events(s, d), LONG),
        "xmap_long": lambda s, d: _skill(cross_map(_all_events(s, d), LONG)),
        "xmap_from_ranks": lambda s, d: _skill_from_ranks(s, d),
        "xmap_sparse_library": lambda s, d: _skill(cross_map(_line_items(s, d), SPARSE)),
        # Vectors
        "vec_pairwise_euclidean": lambda s, d: _tidy(
            op.pairwise_euclidean(_table(s, d, "embeddings"), "vec_id", "embedding", True),
            "mean", "low", "high",
        ),
        "vec_pairwise_pearson": lambda s, d: _tidy(
            op.pairwise_pearson(_table(s, d, "embeddings"), "vec_id", "embedding", True),
            "mean", "low", "high",
        ),
        "vec_rowwise_pearson": lambda s, d: _tidy(
            op.rowwise_pearson(_table(s, d, "embeddings"), _next_vector(_table(s, d, "embeddings")), "vec_id", "embedding"),
            "rho",
        ),
        "argsort": lambda s, d: op.argsort(_table(s, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey"),
    }


def _series_sql() -> dict[str, str]:
    ev, users, counts = sql.series_events(), sql.series_events("CAST(user_id AS VARCHAR)", 86400), sql.series_counts()
    orders = sql.series_counts("orders", "o_orderdate", 86400)
    groups = sql.series_events("CAST(user_id % 4 AS VARCHAR)", 86400)
    every = """series AS (SELECT 'all' AS series_id, count(*) OVER () AS n, row_number() OVER (ORDER BY event_id) - 1 AS i,
        CAST(value AS DOUBLE) AS x, CAST(user_id AS DOUBLE) AS y FROM events)"""
    task_chains = ", ".join(
        f"s{g} AS (SELECT * FROM series WHERE series_id = '{g}'), "
        + sql.chain(g % 2 + 2, g % 3 + 1, [5, 10, 15] if g > 1 else [10], g + 1, f"t{g}", f"s{g}") for g in (1, 2, 3)
    )
    multi_l, sweep_l, pairs = [100, 200, 300, 400], [100, 200, 300], [(2, 1), (2, 2), (3, 1), (3, 2)]
    skill = sql.SKILL_COLUMNS
    single = sql.chain(3, 1, [200], 5)
    user_runs = sql.sweep([(2, 1), (3, 1)], [5, 15, 40], 3)
    scen = sql.scenario((2, 4), (7, 14, 30), (50, 200), 2)
    scen_means = """, means AS (SELECT series_id, width, E, avg(greatest(0, rho)) AS mean_rho
        FROM (SELECT *, max(L) OVER (PARTITION BY series_id, width, E) AS top FROM scen) t WHERE L = top GROUP BY ALL)"""
    library = "SELECT l.series_id, l.E, l.tau, l.L, l.sample, m.i AS idx, l.m FROM lib_{n} l JOIN {n} m ON l.series_id = m.series_id AND l.pos = m.pos"
    knn_rows = """SELECT series_id, E, tau, L, sample, p,
        row_number() OVER (PARTITION BY series_id, E, tau, L, sample, p ORDER BY d, q) AS r, q, round(d, 6) AS d, m FROM knn_m"""
    rank = """SELECT series_id, E, tau, p, q, round(d, 6) AS d, r FROM (
        SELECT a.series_id, a.E, a.tau, a.i AS p, b.i AS q, {d} AS d,
               row_number() OVER (PARTITION BY a.series_id, a.i ORDER BY {d}, b.i) AS r
        FROM m a JOIN m b ON a.series_id = b.series_id AND a.i <> b.i WHERE {where}) t WHERE r <= {k}"""
    draws = "series_id, E, tau, L, sample"
    bought = """SELECT 'all' AS series_id, 1 AS L, CAST(user_id % 2 AS INT) AS sample, count(*) AS m,
        CAST(floor(epoch(ts) / 3600) AS BIGINT) - (SELECT min(CAST(floor(epoch(ts) / 3600) AS BIGINT)) FROM events
            WHERE event_type IN ('click', 'view')) AS idx FROM events WHERE event_type = 'purchase' GROUP BY ALL"""
    centred = """SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS c
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) t"""
    return {
        "series_hourly_events": f"WITH {ev} SELECT * FROM series",
        "series_daily_orders": f"WITH {orders} SELECT * FROM series",
        "series_daily_users": f"WITH {users} SELECT * FROM series",
        "param_grid": f"""WITH {users}, {sql.manifold(2, 1, 'a')}, {sql.manifold(3, 1, 'b')},
            {sql.grid([5, 15, 40], 1, 'a')}, {sql.grid([5, 15, 40], 1, 'b')}
            SELECT series_id, E, tau, n, L, size FROM grid_a UNION ALL SELECT series_id, E, tau, n, L, size FROM grid_b""",
        "skill_json": f"""WITH {ev}, {sql.chain(3, 1, multi_l, 5)} SELECT series_id, E, tau, L,
            '{{"e":' || E || ',"tau":' || tau || ',"l":' || L || ',"result":[' ||
            string_agg(CAST(CAST(round(rho, 6) AS DECIMAL(9,6)) AS VARCHAR), ',' ORDER BY sample) || ']}}' AS json
            FROM skill_m GROUP BY series_id, E, tau, L""",
        "embed_e3_tau1": f"WITH {ev}, {sql.manifold(3, 1)} SELECT series_id, E, tau, i, pos, x0, x1, x2, y FROM m",
        "embed_e2_tau2": f"WITH {users}, {sql.manifold(2, 2)} SELECT series_id, E, tau, i, pos, x0, x1, y FROM m",
        "embed_drop_missing": f"""WITH {sql.series_events(x='avg')}, {sql.manifold(3, 1, drop_missing=True)}
            SELECT series_id, E, tau, i, pos, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2, round(y, 6) AS y FROM m""",
        "rolling_sum_w7": f"WITH {orders}, {sql.rolling('series', 7, 'r')} SELECT series_id, i, x, rolling_sum FROM r",
        "rolling_sum_w10000": f"""WITH {sql.lineitem_series()},
            p AS (SELECT i, sum(CAST(x AS DECIMAL(18,2))) OVER (ORDER BY i) AS upto FROM series)
            SELECT 'all' AS series_id, a.i, CAST(a.upto - coalesce(b.upto, 0) AS DOUBLE) AS rolling_sum
            FROM p a LEFT JOIN p b ON b.i = a.i - 10000 WHERE a.i >= 9999""",
        "accumulate_vs_next": f"WITH {orders}, "
        + ",".join(sql.paired(w, a, f"p_{w}_{a}") for w in (7, 14) for a in (2, 4))
        + " UNION ALL ".join(
            f" SELECT split_part(series_id, '|', 1) AS series_id, {w} AS width, {a} AS ahead, n, i, x, y FROM p_{w}_{a}"
            for w in (7, 14) for a in (2, 4)
        ),
        "pair_distances": f"""WITH {ev}, {sql.manifold(3, 1)} SELECT a.series_id, a.E, a.tau, a.i AS p,
            count(*) AS pairs, round(avg({sql.dist(3)}), 6) AS mean, round(min({sql.dist(3)}), 6) AS low,
            round(max({sql.dist(3)}), 6) AS high
            FROM m a JOIN m b ON a.series_id = b.series_id AND a.i <> b.i GROUP BY ALL""",
        "rank_neighbors_k10": f"WITH {ev}, {sql.manifold(3, 1)} " + rank.format(d=sql.dist(3), where="TRUE", k=10),
        "knn_exclude_zero": f"WITH {orders}, {sql.manifold(2, 1)} "
        + rank.format(d=sql.dist(2), where=f"{sql.dist(2)} >= 1e-30", k=5),
        "knn_library": f"WITH {ev}, {sql.chain(3, 1, [200], 5, upto='knn')} {knn_rows}",
        "knn_library_first": f"WITH {ev}, {sql.chain(3, 1, [200], 5, upto='knn')} {knn_rows}",
        "knn_library_distinct": f"WITH {ev}, {sql.chain(3, 1, [200], 5, upto='knn', distinct=True)} {knn_rows}",
        "knn_given_library": f"""WITH {ev}, {sql.manifold(3, 1)}, {sql.given_library(bought)}, {sql.knn(3)} {knn_rows}""",
        "knn_library_no_zero": f"WITH {counts}, {sql.chain(2, 1, [150], 3, upto='knn', no_zero=True)} {knn_rows}",
        "knn_with_ties": f"WITH {counts}, {sql.chain(2, 1, [150], 3, upto='knn', ties=True)} {knn_rows}",
        "library_with_replacement": f"WITH {ev}, {sql.chain(3, 1, [200], 5, upto='lib')} " + library.format(n="m"),
        "library_without_replacement": f"WITH {ev}, {sql.chain(3, 1, [200], 5, upto='lib', replacement=False)} "
        + library.format(n="m"),
        "library_clamped": f"WITH {users}, "
        + ",".join(sql.chain(E, 1, [5, 15, 40], 3, f"u{E}", upto="lib", replacement=False) for E in (2, 3)) + " "
        + library.format(n="u2") + " UNION ALL " + library.format(n="u3"),
        "simplex_weights": f"WITH {ev}, {sql.chain(3, 1, [200], 5, upto='weights')} SELECT {draws}, p, q, m, round(w, 6) AS w FROM w_m",
        "simplex_weights_ties": f"WITH {counts}, {sql.chain(2, 1, [150], 3, upto='weights', ties=True)} "
        f"SELECT {draws}, p, q, m, round(w, 6) AS w FROM w_m",
        "simplex_predict": f"""WITH {ev}, {sql.chain(3, 1, [200], 5, upto='pred')}
            SELECT {draws}, p, y, round(y_hat, 6) AS y_hat FROM pred_m""",
        "skill_rho": f"WITH {ev}, {single} SELECT {draws}, n_pred, round(rho, 6) AS rho FROM skill_m",
        "skill_rho_nonneg": f"WITH {ev}, {sql.chain(3, 1, multi_l, 5)} "
        f"SELECT {draws}, round(greatest(0, rho), 6) AS rho_nonneg FROM skill_m",
        "skill_mae": f"WITH {ev}, {sql.chain(3, 1, multi_l, 5)} SELECT {draws}, round(mae, 6) AS mae FROM skill_m",
        "xmap_single": f"WITH {ev}, {single} SELECT {skill} FROM skill_m",
        "xmap_multi_l": f"WITH {ev}, {sql.chain(3, 1, multi_l, 5)} SELECT {skill} FROM skill_m",
        "xmap_sweep": f"WITH {ev}, {sql.sweep(pairs, sweep_l, 4)} SELECT {skill} FROM m_skill",
        "xmap_without_replacement": f"WITH {ev}, {sql.chain(3, 1, multi_l, 5, replacement=False)} SELECT {skill} FROM skill_m",
        "xmap_ties": f"WITH {counts}, {sql.chain(2, 1, [150], 3, ties=True)} SELECT {skill} FROM skill_m",
        "xmap_by_user": f"WITH {users}, {user_runs} SELECT {skill} FROM m_skill",
        "scenario_sweep": f"WITH {counts}, {scen} SELECT width, {skill} FROM scen",
        "convergence_curve": f"""WITH {ev}, {sql.sweep(pairs, sweep_l, 4)} SELECT series_id, E, tau, L, count(*) AS draws,
            round(avg(rho), 6) AS mean_rho, round(stddev_pop(rho), 6) AS std_rho,
            round(avg(greatest(0, rho)), 6) AS mean_rho_nonneg, round(avg(mae), 6) AS mean_mae FROM m_skill GROUP BY ALL""",
        "mean_rho_at_max_l": f"""WITH {users}, {user_runs} SELECT series_id, E, tau, L, round(avg(greatest(0, rho)), 6) AS mean_rho
            FROM m_skill WHERE L = 40 GROUP BY ALL""",
        "rho_density": f"""WITH {ev}, {sql.sweep(pairs, sweep_l, 4)},
            r AS (SELECT series_id, E, tau, L, round(rho, 6) AS rho FROM m_skill),
            g AS (SELECT series_id, E, tau, min(L) AS lo_l, max(L) AS hi_l, min(rho) AS lo, max(rho) AS hi FROM r GROUP BY ALL),
            c AS (SELECT r.*, CAST(lo_l AS DOUBLE) AS lo_l, hi_l / 100.0::DOUBLE AS bins,
                         (hi_l - lo_l) / (hi_l / 100.0::DOUBLE) AS wl, lo, (hi - lo) / 100.0::DOUBLE AS wr
                  FROM r JOIN g ON r.series_id = g.series_id AND r.E = g.E AND r.tau = g.tau)
            SELECT series_id, E, tau, CAST(least(floor((L - lo_l) / wl), ceil(bins) - 1) AS INT) AS l_bin,
                   CASE WHEN wr > 0 THEN CAST(least(floor((rho - lo) / wr), 99) AS INT) ELSE 0 END AS value_bin, count(*) AS n
            FROM c GROUP BY ALL""",
        "scenario_pivot": f"""WITH {counts}, {scen}{scen_means} SELECT series_id, width,
            round(max(CASE WHEN E = 2 THEN mean_rho END), 6) AS E_2, round(max(CASE WHEN E = 4 THEN mean_rho END), 6) AS E_4
            FROM means GROUP BY ALL""",
        "scenario_unpivot": f"""WITH {counts}, {scen}{scen_means}
            SELECT series_id, width, 'E_' || E AS variable, round(mean_rho, 6) AS value FROM means""",
        "compare_skill": f"""WITH {ev}, {sql.chain(3, 1, multi_l, 5, 'a')}, {sql.chain(3, 1, multi_l, 5, 'b', replacement=False)},
            ca AS (SELECT series_id, E, tau, L, count(*) AS draws_a, avg(rho) AS mean_a FROM skill_a GROUP BY ALL),
            cb AS (SELECT series_id, E, tau, L, count(*) AS draws_b, avg(rho) AS mean_b FROM skill_b GROUP BY ALL)
            SELECT ca.series_id, ca.E, ca.tau, ca.L, draws_a, round(mean_a, 6) AS mean_a, draws_b, round(mean_b, 6) AS mean_b,
                   round(mean_b - mean_a, 6) AS difference FROM ca JOIN cb ON ca.L = cb.L""",
        "xmap_tasks": f"WITH {groups}, {task_chains} "
        + " UNION ALL ".join(f"SELECT 'groups/odd={g % 2}' AS outputpath, {skill} FROM skill_t{g}" for g in (1, 2, 3)),
        "series_csv": """SELECT 'all' AS series_id, count(*) OVER () AS n, row_number() OVER (ORDER BY o_orderkey) - 1 AS i,
            CAST(o_totalprice AS DOUBLE) AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders""",
        "series_paired": f"WITH {users} SELECT * FROM series",
        "skill_stored": f"""WITH {ev}, {sql.sweep(pairs, sweep_l, 4)}
            SELECT CAST(E AS INT) AS E, CAST(tau AS INT) AS tau, CAST(L AS INT) AS lib_size, round(rho, 6) AS rho FROM m_skill""",
        "runtime_compare": """WITH r AS (SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS query_a,
                CAST(count(*) AS DOUBLE) AS o, CAST(sum(o_custkey) AS DOUBLE) AS query_b FROM orders GROUP BY 1)
            SELECT o_orderpriority, round(query_a, 6) AS query_a, round(query_b, 6) AS query_b, round(query_a + o, 6) AS total_a,
                round(query_b + 1, 6) AS total_b, round(query_a / query_b, 6) AS query_speedup,
                round((query_a + o) / (query_b + 1), 6) AS total_speedup FROM r""",
        "rank_neighbors_long": f"""WITH {every}, {sql.manifold(2, 1)}, near AS (
            SELECT a.series_id, a.E, a.tau, a.i AS p, unnest(min_by({{'q': b.i, 'd': {sql.dist(2)}}}, ({sql.dist(2)}, b.i), 3)) AS t,
                   generate_subscripts(min_by(b.i, ({sql.dist(2)}, b.i), 3), 1) AS r
            FROM m a JOIN m b ON a.series_id = b.series_id AND a.i <> b.i GROUP BY a.series_id, a.E, a.tau, a.i)
            SELECT series_id, E, tau, p, t.q AS q, round(t.d, 6) AS d, CAST(r AS INT) AS r FROM near""",
        "knn_library_long": f"WITH {every}, {sql.chain(2, 1, [500], 2, upto='knn')} {knn_rows}",
        "xmap_long": f"WITH {every}, {sql.chain(2, 1, [500], 2)} SELECT {skill} FROM skill_m",
        "xmap_from_ranks": f"WITH {ev}, {sql.chain(3, 1, multi_l, 5)} SELECT {skill} FROM skill_m",
        "xmap_sparse_library": f"WITH {sql.lineitem_series()}, {sql.chain(2, 1, [200], 2)} SELECT {skill} FROM skill_m",
        "vec_pairwise_euclidean": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
            d AS (SELECT a.vec_id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id)
            SELECT vec_id, count(*) AS pairs, round(avg(d), 6) AS mean, round(min(d), 6) AS low, round(max(d), 6) AS high
            FROM d GROUP BY ALL""",
        "vec_pairwise_pearson": f"""WITH v AS ({centred}),
            d AS (SELECT a.vec_id, list_cosine_similarity(a.c, b.c) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id)
            SELECT vec_id, count(*) AS pairs, round(avg(d), 6) AS mean, round(min(d), 6) AS low, round(max(d), 6) AS high
            FROM d GROUP BY ALL""",
        "vec_rowwise_pearson": f"""WITH v AS ({centred}) SELECT a.vec_id, round(list_cosine_similarity(a.c, b.c), 6) AS rho
            FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
        "argsort": """SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1
            AS rank, o_orderkey, o_totalprice FROM orders""",
    }
