"""Uniform grid over the domain: cell index per dimension and one id per cell."""

from __future__ import annotations

from collections.abc import Sequence

from outskirt.functions.numeric import lit
from outskirt.params import ScoreParams


def raw_cell_index(v: str, p: ScoreParams) -> str:
    """Grid index without any limit; monotone in ``v``."""
    shifted = v if p.domain_min == 0.0 else f"({v} - {lit(p.domain_min)})"
    return f"floor({shifted} / {lit(p.cell_width)})"


def cell_index(v: str, p: ScoreParams) -> str:
    """Index of the cell holding ``v``; the domain maximum is in the last cell."""
    return f"cast(least({raw_cell_index(v, p)}, {p.cells - 1}) as int)"


def nearest_cell_index(v: str, p: ScoreParams) -> str:
    """Like :func:`cell_index`, with values outside the domain in the border cells; monotone in ``v``."""
    return f"cast(greatest(0, least({raw_cell_index(v, p)}, {p.cells - 1})) as int)"


def in_domain(values: Sequence[str], p: ScoreParams) -> str:
    return " and ".join(f"{v} between {lit(p.domain_min)} and {lit(p.domain_max)}" for v in values)


def cell_id(indexes: Sequence[str], cells: int) -> str:
    """One BIGINT per cell: index of dimension i counts ``cells^i``."""
    if cells ** len(indexes) >= 2**63:
        raise ValueError("the grid has more cells than a BIGINT can number")
    return " + ".join(f"cast({ix} as bigint) * {cells**i}L" for i, ix in enumerate(indexes))


def cell_indexes(cell: str, dims: int, cells: int) -> list[str]:
    """The per-dimension indexes of a cell id (inverse of :func:`cell_id`)."""
    return [f"cast(({cell} div {cells**i}L) % {cells}L as int)" for i in range(dims)]
