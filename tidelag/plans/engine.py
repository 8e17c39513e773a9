"""End-to-end runs, each one lazy plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.operators.embedding import accumulate_vs_next, embed, lengths, manifold_lengths
from tidelag.operators.neighbors import knn_in_library
from tidelag.operators.simplex import simplex_forecast, simplex_predict, simplex_weights
from tidelag.operators.skill import skill
from tidelag.operators.stored_ranks import RankTable
from tidelag.spec import LengthRange, Spec
from tidelag.staging import stage


def manifold_of(series: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(points, lengths) of all manifolds of the sweep."""
    points = embed(series, spec.pairs, spec.drop_missing)
    return points, manifold_lengths(points) if spec.drop_missing else lengths(series, spec.pairs)


def neighbours(
    series: DataFrame, spec: Spec, k: int | None = None, library: DataFrame | None = None, ranks: RankTable | None = None
) -> DataFrame:
    """The nearest library members of every point. ``library`` (series_id, E, tau, L, sample, idx,
    m) names the members; without it they are drawn. ``ranks``: a stored rank table that holds
    the manifolds, from which they are read instead of measured."""
    points = embed(series, spec.pairs, spec.drop_missing)
    if ranks is not None:
        if library is not None or spec.drop_missing:
            raise ValueError("a rank table answers drawn libraries of whole manifolds")
        return ranks.knn(points, spec, k, sizes=_sizes(series, spec))
    return knn_in_library(points, spec, k, sizes=_sizes(series, spec), library=library, pairs=None if spec.drop_missing else spec.pairs)


def _sizes(series: DataFrame, spec: Spec, pairs=None) -> DataFrame | None:
    """Numbers of points as far as they follow from the lengths of the series."""
    return None if spec.drop_missing else lengths(series, pairs or spec.pairs)


def _forecasts(found: DataFrame, spec: Spec, largest: int) -> DataFrame:
    if spec.ties == "include":
        return simplex_predict(simplex_weights(found, spec.weight_floor, "include"))
    return simplex_forecast(found, largest + 1, spec.weight_floor)


def forecasts(series: DataFrame, spec: Spec, library: DataFrame | None = None, ranks: RankTable | None = None) -> DataFrame:
    """series_id, E, tau, L, sample, p, y, y_hat."""
    return _forecasts(neighbours(series, spec, library=library, ranks=ranks), spec, max(spec.E))


def cross_map(
    series: DataFrame, spec: Spec, grid: DataFrame | None = None, library: DataFrame | None = None, ranks: RankTable | None = None
) -> DataFrame:
    """Cross-map skill of ``series`` (series_id, i, x, y) over the whole grid: does the
    history of x recover y? E, tau and L are columns, so a sweep is one plan.

    ``grid`` (series_id, E, tau, L, samples) names what to run for each series instead of
    spec's E, tau, L and samples, as task files do; of equal rows the most samples count.
    Its distinct (E, tau), a few, are looked up when this is called. ``library`` gives the
    members of every draw instead, and ``ranks`` a stored rank table, as in ``neighbours``."""
    if grid is None:
        return skill(forecasts(series, spec, library, ranks))
    pairs = [(r["E"], r["tau"]) for r in grid.select("E", "tau").distinct().collect()]
    if not pairs:
        raise ValueError("the grid is empty")
    wanted = grid.groupBy("series_id", "E", "tau", "L").agg(F.max("samples").alias("samples"))
    runs = wanted.groupBy("series_id", "E", "tau").agg(
        F.sort_array(F.collect_list(F.struct(F.col("L").cast("int").alias("L"), F.col("samples").cast("int").alias("samples")))).alias("runs")
    )
    points, sizes = embed(series, pairs, spec.drop_missing), _sizes(series, spec, pairs)
    found = knn_in_library(points, spec, runs=runs, sizes=sizes, pairs=None if spec.drop_missing else pairs) if ranks is None else ranks.knn(points, spec, runs=runs, sizes=sizes)
    return skill(_forecasts(found, spec, max(E for E, _ in pairs)))


def scenario_sweep(counts: DataFrame, col: str, E, widths, spec: Spec, decimals: int | None = None) -> DataFrame:
    """For each trailing-sum width and each E: cross-map the sum against the value E steps
    later, with libraries from spec.L up to the length of the paired series. Adds column
    ``width`` to the skill rows. ``decimals`` as in accumulate_vs_next. One plan: every E is embedded, and each paired series keeps
    the one that it looks ahead."""
    spec = replace(spec, E=tuple(E))
    parts = lambda s: f"split({s}, '[|]')"
    paired = accumulate_vs_next(counts, col, widths, E, decimals=decimals).selectExpr(
        "concat_ws('|', series_id, width, ahead) AS series_id", "n", "i", "x", "y"
    )
    points = embed(paired, spec.pairs, spec.drop_missing).where(f"element_at({parts('series_id')}, -1) = CAST(E AS STRING)")
    points = points.withColumn("series_id", F.expr(f"array_join(slice({parts('series_id')}, 1, size({parts('series_id')}) - 1), '|')"))
    every = skill(_forecasts(knn_in_library(points, spec), spec, max(spec.E)))
    name = parts("series_id")
    return every.selectExpr(
        f"CAST(element_at({name}, -1) AS INT) AS width", f"array_join(slice({name}, 1, size({name}) - 1), '|') AS series_id",
        *[c for c in every.columns if c != "series_id"],
    )


__all__ = ["LengthRange", "cross_map", "forecasts", "manifold_of", "neighbours", "scenario_sweep", "stage"]
