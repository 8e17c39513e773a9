"""Weights and forecasts from neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.functions import simplex_weight
from tidelag.operators.neighbors import POINT


def simplex_weights(found: DataFrame, floor: float = 1e-6, ties: str = "ignore", k: int | None = None) -> DataFrame:
    """Add array ``w`` beside the neighbours. With ties='include' the places left at the
    last distance are shared among all neighbours tied there."""
    found = found.selectExpr("*", f"transform(d, a -> {simplex_weight('a', 'get(d, 0)', floor)}) AS w")
    if ties != "include":
        return found
    places = "E + 1" if k is None else k
    last = "d[size(d) - 1]"
    tied = f"aggregate(filter(arrays_zip(d, m), a -> a.d = {last}), 0D, (acc, a) -> acc + a.m)"
    total = "aggregate(m, 0D, (acc, a) -> acc + a)"
    share = f"CASE WHEN size(d) > 0 AND {total} > {places} THEN ({tied} + {places} - {total}) / {tied} ELSE 1D END"
    return (
        found.selectExpr("*", f"{share} AS _share")
        .withColumn("w", F.expr(f"zip_with(w, d, (w, d1) -> CASE WHEN d1 = {last} THEN w * _share ELSE w END)"))
        .drop("_share")
    )


def simplex_predict(weighted: DataFrame) -> DataFrame:
    """Weighted mean of the neighbours' targets: ..., p, y, y_hat. NULL without neighbours
    or when a neighbour's target is missing."""
    top = "aggregate(arrays_zip(m, w, yq), 0D, (acc, a) -> acc + a.m * a.w * a.yq)"
    bottom = "aggregate(arrays_zip(m, w), 0D, (acc, a) -> acc + a.m * a.w)"
    return weighted.selectExpr(*POINT, f"try_divide({top}, {bottom}) AS y_hat")


def simplex_forecast(found: DataFrame, k_max: int, floor: float = 1e-6) -> DataFrame:
    """simplex_weights and simplex_predict in one projection for at most ``k_max``
    neighbours. Written out place by place it compiles to plain code, which array lambdas
    do not."""
    places = range(k_max)
    weighted = found.selectExpr(
        *POINT, "size(d) AS _size",
        *[f"get(d, {j}) AS _d{j}" for j in places],
        *[f"get(m, {j}) * {simplex_weight(f'_d{j}', '_d0', floor)} AS _w{j}" for j in places],
        *[f"get(yq, {j}) AS _y{j}" for j in places],
    )
    top = " + ".join(f"CASE WHEN _size > {j} THEN _w{j} * _y{j} ELSE 0D END" for j in places)
    bottom = " + ".join(f"CASE WHEN _size > {j} THEN _w{j} ELSE 0D END" for j in places)
    return weighted.selectExpr(*POINT, f"try_divide({top}, {bottom}) AS y_hat")
