from tidelag.operators.analysis import (
    compare_skill, convergence, density, mean_at_max_l, pivot_mean, runtime_compare, runtime_totals, unpivot_mean,
)
from tidelag.operators.embedding import accumulate_vs_next, drop_invalid, embed, lengths, rolling_sum, valid_points
from tidelag.operators.library import draw_libraries, library_grid, library_points
from tidelag.operators.neighbors import explode_neighbors, knn_in_library, pair_distances
from tidelag.operators.ordering import dense_rank_of
from tidelag.operators.ranking import rank_neighbors
from tidelag.operators.simplex import simplex_forecast, simplex_predict, simplex_weights
from tidelag.operators.skill import skill
from tidelag.operators.stored_ranks import RankTable
from tidelag.operators.vectors import argsort, array_pearson, pairwise_euclidean, pairwise_pearson, rowwise_pearson

__all__ = [
    "RankTable", "accumulate_vs_next", "argsort", "array_pearson", "compare_skill", "convergence", "dense_rank_of", "density", "draw_libraries",
    "drop_invalid", "embed", "explode_neighbors", "knn_in_library", "lengths", "library_grid", "library_points",
    "mean_at_max_l", "pair_distances", "pairwise_euclidean", "pairwise_pearson", "pivot_mean", "rank_neighbors",
    "rolling_sum", "rowwise_pearson", "runtime_compare", "runtime_totals", "simplex_forecast", "simplex_predict",
    "simplex_weights", "skill", "unpivot_mean", "valid_points",
]
