"""Parameters of indexes and queries."""

from __future__ import annotations

from dataclasses import dataclass


def power_of_two(x: int) -> int:
    """The least power of two that is not below x."""
    return 1 << max(0, (x - 1).bit_length())


@dataclass(frozen=True)
class IndexConfig:
    """dim: of the vectors; n_proj directions in each of n_repeats rotations; top_m points kept per direction and sign.

    seed -1 or None stands for DEFAULT_SEED, so that an index can always be rebuilt.
    """

    dim: int
    n_proj: int = 256
    n_repeats: int = 1
    top_m: int = 100
    seed: int | None = None
    centering: bool = False

    DEFAULT_SEED = 42

    def __post_init__(self):
        for name in ("dim", "n_proj", "n_repeats", "top_m"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")

    @property
    def width(self) -> int:
        """Of the rotation: holds the vector and the directions."""
        return power_of_two(max(self.dim, self.n_proj))

    @property
    def directions(self) -> int:
        return self.n_proj * self.n_repeats

    @property
    def sign_seed(self) -> int:
        return self.DEFAULT_SEED if self.seed is None or self.seed < 0 else self.seed


@dataclass(frozen=True)
class QueryConfig:
    """k results; n_probed_vectors directions a query; n_probed_points of each bucket (all if None); n_cand scored exactly."""

    k: int = 10
    n_probed_vectors: int = 10
    n_probed_points: int | None = None
    n_cand: int = 100
    estimator: str = "sum"

    def check(self, index: IndexConfig) -> None:
        if min(self.k, self.n_probed_vectors, self.n_cand) < 1:
            raise ValueError("k, n_probed_vectors and n_cand must be positive")
        if self.n_probed_vectors > index.directions:
            raise ValueError("n_probed_vectors is more than there are directions")
        if self.n_probed_points is not None and not 0 < self.n_probed_points <= index.top_m:
            raise ValueError("n_probed_points must be in 1 to top_m")
        if self.estimator not in ("sum", "mean"):
            raise ValueError("estimator must be sum or mean")

    def prefix(self, index: IndexConfig) -> int:
        return index.top_m if self.n_probed_points is None else self.n_probed_points
