"""Cell histogram, per-dimension slab counts and the uniformity order of dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.functions.cells import cell_id, cell_index, in_domain, nearest_cell_index
from outskirt.functions.geometry import items
from outskirt.functions.numeric import lit
from outskirt.params import ScoreParams


def index_names(p: ScoreParams) -> list[str]:
    return [f"i{d}" for d in range(p.dims)]


def placed(points: DataFrame, p: ScoreParams, *columns: str, every: bool = False) -> DataFrame:
    """``columns`` and ``i0, i1, ...`` of the points inside the domain; with ``every``, of all points,
    those outside in the border cells."""
    xs = items("c", p.dims)
    if every:
        indexes = [f"{nearest_cell_index(x, p)} as {name}" for x, name in zip(xs, index_names(p))]
        return points.selectExpr(*columns, *indexes)
    indexes = [f"{cell_index(x, p)} as {name}" for x, name in zip(xs, index_names(p))]
    return points.where(in_domain(xs, p)).selectExpr(*columns, *indexes)


def with_cells(points: DataFrame, p: ScoreParams) -> DataFrame:
    """Points inside the domain with ``i0, i1, ...`` and ``cell_id``."""
    return placed(points, p, "*").selectExpr("*", f"{cell_id(index_names(p), p.cells)} as cell_id")


def cell_histogram(points: DataFrame, p: ScoreParams, every: bool = False) -> DataFrame:
    """``i0, i1, ..., n``: points per occupied cell (counts merge before the shuffle)."""
    return placed(points, p, every=every).groupBy(*index_names(p)).agg(F.expr("count(1)").alias("n"))


def slab_frequency(histogram: DataFrame, p: ScoreParams) -> DataFrame:
    """``dim, idx, n``: points per grid slab of each dimension, from the histogram."""
    pairs = ", ".join(f"{d}, {name}" for d, name in enumerate(index_names(p)))
    return (
        histogram.selectExpr(f"stack({p.dims}, {pairs}) as (dim, idx)", "n")
        .groupBy("dim", "idx")
        .agg(F.sum("n").alias("n"))
    )


def chi_square(slabs: DataFrame, p: ScoreParams) -> DataFrame:
    """``dim, chi2`` against a uniform spread over ``cells + 1`` bins, empty ones included."""
    stat = f"sum(n * n) * {lit(p.cells + 1)} / sum(n) - sum(n)"
    return slabs.groupBy("dim").agg(F.expr(stat).alias("chi2"))


def dimension_order(slabs: DataFrame, p: ScoreParams) -> list[int]:
    """Dimensions, most uniform first (one row per dimension reaches the driver)."""
    order = [r["dim"] for r in chi_square(slabs, p).orderBy("chi2", "dim").collect()]
    return order + [d for d in range(p.dims) if d not in order]
