"""Settings of a scoring run."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ScoreParams:
    """Every knob of the scoring job; the values become literals in the plans.

    A ``*_scale`` of ``None`` switches that rounding off.
    """

    k: int = 10
    dims: int = 2
    domain_min: float = 0.0
    domain_max: float = 100.0
    cells: int = 50
    buckets: int = 4
    denominator: int = 1
    metric: str = "l2"
    point_scale: int | None = 4
    dist_scale: int | None = 2
    force_scale: int | None = 4
    lcf_scale: int | None = 2
    nof_scale: int | None = 4
    # rows per leaf box: one leaf is the unit of work of a neighbour search
    leaf_rows: int = 256
    # largest difference of two coordinates, where known (else eight domain widths are allowed for)
    extent: float | None = None

    def __post_init__(self) -> None:
        if self.k < 1 or self.dims < 1 or self.cells < 1 or self.buckets < 1:
            raise ValueError("k, dims, cells and buckets must be at least 1")
        if self.denominator < 1:
            raise ValueError("denominator must be at least 1")
        if not self.domain_max > self.domain_min:
            raise ValueError("domain_max must be above domain_min")
        if self.metric not in ("l1", "l2"):
            raise ValueError("metric must be 'l1' or 'l2'")
        if self.leaf_rows < self.k + 2:
            object.__setattr__(self, "leaf_rows", self.k + 2)

    @property
    def cell_width(self) -> float:
        return (self.domain_max - self.domain_min) / self.cells

    @property
    def wide(self) -> bool:
        """Whether sums of forces may leave the BIGINT range; they are DECIMAL then."""
        far = 8 * (self.domain_max - self.domain_min) if self.extent is None else self.extent
        reach = far * (self.dims if self.metric == "l1" else self.dims**0.5)
        scale = max(self.force_scale or 0, self.lcf_scale or 0)
        return self.k**2 * self.dims * far * reach**2 * 10.0**scale >= 2.0**62

    def with_(self, **changes) -> "ScoreParams":
        return replace(self, **changes)

    @classmethod
    def from_json(cls, path: str, **overrides) -> "ScoreParams":
        """Read a ``{"general": {...}}`` configuration file."""
        with open(path) as f:
            general = json.load(f)["general"]
        # The configuration keys in use and their defaults.
        fields = dict(
            denominator=general.get("denominator", 100),
            k=general.get("k_nn", 10),
            dims=general.get("dim_expression", 2),
            cells=general.get("num_of_small_cells", 501),
            domain_min=float(general.get("domain_min", 0.0)),
            domain_max=float(general.get("domain_max", 10001.0)),
            buckets=general.get("di_num_buckets", 2),
        )
        return cls(**{**fields, **overrides})
