from tidelag.plans.engine import cross_map, forecasts, manifold_of, neighbours, scenario_sweep, stage

__all__ = ["cross_map", "forecasts", "manifold_of", "neighbours", "scenario_sweep", "stage"]
