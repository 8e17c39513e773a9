"""Parameters of a cross-mapping run."""

from __future__ import annotations

from dataclasses import dataclass, field


def param_values(start: int, stop: int, step: int) -> tuple[int, ...]:
    """Library sizes from ``start`` to ``stop``; ``stop`` belongs to the grid."""
    validate_grid([start], [stop], [step], 1)
    return tuple(range(start, stop + 1, step))


def validate_grid(E, tau, L, samples) -> None:
    """Every parameter must be a whole number above zero."""
    for name, values in (("E", E), ("tau", tau), ("L", L), ("samples", [samples])):
        values = list(values)
        if not values:
            raise ValueError(f"{name} is empty")
        for value in values:
            if isinstance(value, bool) or int(value) != value or value <= 0:
                raise ValueError(f"{name} must be a whole number above zero, got {value!r}")


@dataclass(frozen=True)
class LengthRange:
    """Library sizes ``start, start+step, ...`` up to the length of each series."""

    start: int
    step: int


@dataclass(frozen=True)
class Spec:
    """What to run. The grid is E x tau x L, with ``samples`` draws at every point.

    replacement            draw library points with (default) or without replacement
    distinct_library       a point drawn twice counts once as a neighbour
    ties                   'ignore' cuts after k neighbours in (distance, index) order,
                           'include' keeps everything as near as the k-th one
    exclude_zero_distance  points at distance 0 are never neighbours
    drop_missing           lag vectors with a missing coordinate leave the manifold
    strategy               'shared' ranks all points once for many draws, 'library_first'
                           measures each draw on its own, against its members only; 'auto'
                           takes what is less work for each series
    """

    E: tuple[int, ...] = (3,)
    tau: tuple[int, ...] = (1,)
    L: tuple[int, ...] | LengthRange = (200,)
    samples: int = 5
    seed: int = 42
    replacement: bool = True
    distinct_library: bool = False
    ties: str = "ignore"
    exclude_zero_distance: bool = False
    weight_floor: float = 1e-6
    drop_missing: bool = False
    strategy: str = "auto"
    pairs: tuple[tuple[int, int], ...] = field(init=False)

    def __post_init__(self):
        L = [self.L.start, self.L.step] if isinstance(self.L, LengthRange) else self.L
        validate_grid(self.E, self.tau, L, self.samples)
        if self.ties not in ("ignore", "include"):
            raise ValueError(f"ties must be 'ignore' or 'include', got {self.ties!r}")
        if self.strategy not in ("auto", "shared", "library_first"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.weight_floor < 0:
            raise ValueError("weight_floor must not be negative")
        object.__setattr__(self, "pairs", tuple((e, t) for e in self.E for t in self.tau))
