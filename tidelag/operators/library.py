"""Random libraries: which points of a manifold may serve as neighbours.

A draw is a function of (seed, series, E, tau, L, sample, draw number) alone, so a rerun,
a lost executor or another partition count gives the same libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.functions import explode_range, mix_end, mix_middle, mix_start, permuted, seeded_hash
from tidelag.spec import LengthRange, Spec

GRID = ["series_id", "E", "tau", "n", "L", "size"]


def runs_of(spec: Spec) -> str:
    """Library sizes and samples of a manifold with columns n, E, tau: array of (L, samples)."""
    if not isinstance(spec.L, LengthRange):
        return f"array({', '.join(f'struct({L} AS L, {spec.samples} AS samples)' for L in spec.L)})"
    series_n = "n" if spec.drop_missing else "(n + (E - 1) * tau)"
    sizes = f"sequence({spec.L.start}L, {series_n}, {spec.L.step}L)"
    none = "CAST(array() AS ARRAY<STRUCT<L: INT, samples: INT>>)"
    runs = f"transform({sizes}, l -> struct(CAST(l AS INT) AS L, {spec.samples} AS samples))"
    return f"CASE WHEN {series_n} >= {spec.L.start} THEN {runs} ELSE {none} END"


def library_grid(lengths: DataFrame, spec: Spec) -> DataFrame:
    """One row per grid point. ``size`` is L cut to the number of points there are."""
    grid = lengths.selectExpr("series_id", "E", "tau", "n", f"inline({runs_of(spec)})")
    return grid.selectExpr("series_id", "E", "tau", "n", "L", "least(CAST(L AS BIGINT), n) AS size")


def ticket(seed: int, L: str, sample: str) -> str:
    """The number from which all draws of a sample follow."""
    return seeded_hash(str(seed), "series_id", "E", "tau", L, sample)


def drawn_by(spec: Spec) -> str:
    """All draws of a manifold with columns series_id, E, tau, n and runs, in the order of their
    numbers: array of (L, size, sample, ticket)."""
    every = "flatten(transform(runs, r -> transform(sequence(0, r.samples - 1), s -> struct(r.L AS L, s AS sample))))"
    return (
        f"transform({every}, t -> struct(t.L AS L, least(CAST(t.L AS BIGINT), n) AS size, t.sample AS sample, "
        f"{ticket(spec.seed, 't.L', 't.sample')} AS ticket))"
    )


def draw_positions(draws: DataFrame, spec: Spec) -> DataFrame:
    """``draws`` (with n, size, ticket) with one row per draw and drawn point, ``pos``; with
    replacement a point may come several times.

    Draws are numbered in blocks that are dealt over all tasks, so neither a large library nor a
    long series is drawn in one. Every number follows from its own place, with or without
    replacement, so nothing is sorted and nothing as long as the series is held."""
    partitions = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [f"`{c}`" for c in draws.columns]
    rows = explode_range(draws, "_j", "size", lambda blocks: blocks.repartition(partitions, "ticket", "_block"))
    if not spec.replacement:
        return permuted(rows, "pos", "ticket", "_j", "n").drop("_j")
    rows = rows.selectExpr("*", f"{mix_start('ticket', '_j')} AS _a").selectExpr("*", f"{mix_middle('ticket', '_a')} AS _b")
    # coalesce: never NULL, or a join on pos would test, and so compute, it twice.
    return rows.selectExpr(*columns, f"coalesce(({mix_end('ticket', '_b')}) % n, 0L) AS pos")


def draw_libraries(lengths: DataFrame, spec: Spec) -> DataFrame:
    """Libraries as rows: the grid columns, sample, pos (point number) and m (times drawn)."""
    draws = explode_range(library_grid(lengths, spec), "_s", str(spec.samples))
    draws = draws.selectExpr(*GRID, "CAST(_s AS INT) AS sample", f"{ticket(spec.seed, 'L', '_s')} AS ticket")
    drawn = draw_positions(draws, spec)
    if not spec.replacement:
        return drawn.selectExpr(*GRID, "sample", "pos", "1 AS m")
    return drawn.groupBy(*GRID, "sample", "pos").agg(F.expr("CAST(count(*) AS INT) AS m"))


def library_points(libraries: DataFrame, manifold: DataFrame) -> DataFrame:
    """Libraries with the time index of each drawn point: series_id, E, tau, L, sample,
    idx, m."""
    points = manifold.select("series_id", "E", "tau", "pos", F.col("i").alias("idx"))
    return libraries.join(points, ["series_id", "E", "tau", "pos"]).select(
        "series_id", "E", "tau", "L", "sample", "idx", "m"
    )
