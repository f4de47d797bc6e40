"""End to end: a point table in, one scored row per point out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outskirt.functions.neighbors import to_text
from outskirt.operators import support
from outskirt.operators.copies import spread_to_copies
from outskirt.operators.knn import exact_knn, nearest_neighbors
from outskirt.operators.points import as_points, coordinate_columns, normalize, rejections, sample_by_id
from outskirt.operators.score import mean_neighbor_force, net_force, scored_neighbors
from outskirt.params import ScoreParams
from outskirt.plans.grid_plan import partition_plan
from outskirt.session import keep, keep_small
from outskirt.sources.tables import read_parquet_points, write_parquet


def score_points(points: DataFrame, p: ScoreParams, plan: DataFrame | None = None) -> DataFrame:
    """``id, c, kdist, lcf, nof`` for every row of ``points`` (``id, c``; ids are unique), in or outside the domain."""
    found = nearest_neighbors(points, p, plan=plan)
    # The extent of the points decides how forces are summed.
    p = p.with_(extent=found.extent)
    forces = keep(net_force(found.table, p).select("id", "c", "place", "nid", "kdist", "lcf"))
    scored = mean_neighbor_force(forces, p, found.rows)
    if found.crowded:
        scored = keep(scored)
    return spread_to_copies(points, scored, p.k, found.crowded)


def measured(points: DataFrame, p: ScoreParams) -> ScoreParams:
    """``p`` with the extent of the points, which decides how forces are summed."""
    low, high = points.selectExpr("min(array_min(c))", "max(array_max(c))").first()
    return p.with_(extent=0.0 if low is None else high - low)


def score_table(df: DataFrame, p: ScoreParams, rescale: bool = True) -> DataFrame:
    """Score a positional table (id first, then coordinates); more columns are ignored.

    ``rescale`` maps each coordinate to the domain first, as the ingest step does.
    """
    df = df.select(df.columns[0], *coordinate_columns(df, p.dims))
    if rescale:
        df = normalize(df, low=p.domain_min, high=p.domain_max, scale=p.point_scale)
    return score_points(as_points(df, p), p)


def result_rows(points: DataFrame, p: ScoreParams, plan: DataFrame | None = None) -> DataFrame:
    """``id, c, pid, status, kdist, lcf, nof, neighbors, supports`` for every point.

    ``status`` tells how far the point's own partition got: ``F`` its neighbours may lie
    elsewhere, ``L`` its force is final, ``O`` its score is. ``neighbors`` is JSON text,
    ``supports`` the other partitions that need the point.
    """
    points = keep(points)
    p = measured(points, p)
    if plan is None:
        plan = partition_plan(points, p)
    plan = keep_small(plan, p.buckets**p.dims)
    status = keep(support.ball_status(support.local_neighbors(points, plan, p), plan, p))
    cells = support.support_cells(support.partition_expansion(status, plan, p), p)
    forces = keep(
        net_force(exact_knn(points, p), p).select("id", "c", "nid", "nd", "nc", "kdist", "lcf")
    )
    rows = forces.count()
    local = keep(net_force(status, p).select("id", "pid", "nid", "lcf", "status"))
    return (
        scored_neighbors(forces, p, rows)
        .join(support.settlement(local, p, rows), "id")
        .join(support.points_with_support(points, cells, p).drop("c"), "id")
        .selectExpr(
            "id", "c", "pid", "status", "kdist", "lcf", "nof", f"{to_text('neighbors')} as neighbors", "pids as supports"
        )
    )


def score_files(spark: SparkSession, source: str, target: str, p: ScoreParams, detail: bool = False) -> dict[str, int]:
    """Score a Parquet point table on the domain and write one row per point.

    With ``detail`` the full result rows are written; the partition plan is then made from
    the rows whose id is a multiple of ``denominator``. Returns how many rows there are (``rows``), how many
    were left out for lack of a value (``no_value``) or outside the domain (``outside``), and how many ``kept``.
    """
    table = read_parquet_points(spark, source, p.dims)
    points = as_points(table, p)
    counts = rejections(table, p).first().asDict()
    if not detail:
        write_parquet(score_points(points, p), target)
        return counts
    sample = table if p.denominator == 1 else sample_by_id(table, p.denominator)
    write_parquet(result_rows(points, p, partition_plan(as_points(sample, p), p)), target)
    return counts
