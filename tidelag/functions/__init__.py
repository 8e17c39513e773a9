"""Column expressions shared by the operators."""

from tidelag.functions.expressions import (
    epoch_seconds,
    explode_range,
    mix_end,
    mix_middle,
    mix_start,
    pearson,
    permuted,
    seeded_hash,
    simplex_weight,
)

__all__ = ["epoch_seconds", "explode_range", "mix_end", "mix_middle", "mix_start", "pearson", "permuted", "seeded_hash", "simplex_weight"]
