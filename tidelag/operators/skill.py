"""How well forecasts match: one row per library draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.functions import pearson

DRAW = ["series_id", "E", "tau", "L", "sample"]


def skill(predictions: DataFrame) -> DataFrame:
    """series_id, E, tau, L, sample, n_pred, rho, rho_nonneg, mae. Pairs with a missing
    value are skipped; rho is 0 when there is nothing to correlate."""
    both = "y IS NOT NULL AND y_hat IS NOT NULL"
    out = predictions.groupBy(*DRAW).agg(
        F.expr(f"count(*) FILTER (WHERE {both}) AS n_pred"),
        F.expr(f"{pearson('y', 'y_hat')} AS rho"),
        F.expr("avg(abs(y_hat - y)) AS mae"),
    )
    return out.selectExpr(*DRAW, "n_pred", "rho", "greatest(0D, rho) AS rho_nonneg", "mae")
