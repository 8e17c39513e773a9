"""Cross mapping between time series as Spark DataFrame plans."""

from tidelag.plans.engine import cross_map, forecasts, neighbours, scenario_sweep, stage
from tidelag.spec import LengthRange, Spec, param_values, validate_grid

__all__ = [
    "LengthRange", "Spec", "cross_map", "forecasts", "neighbours", "param_values", "scenario_sweep", "stage", "validate_grid",
]
