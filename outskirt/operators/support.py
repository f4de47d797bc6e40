"""Partition borders: which points need other partitions, and which cells support which.

A point is ``T`` when its own partition already gives its final neighbours, else ``F``.
With the neighbours final and theirs too, the score is final as well: ``O``; ``T`` points
that still wait for a neighbour's force are ``L``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.functions.cells import cell_id, cell_index, raw_cell_index
from outskirt.functions.geometry import box_centre, l2
from outskirt.functions.numeric import lit, round_up
from outskirt.operators.histogram import index_names, placed, with_cells
from outskirt.operators.joins import lookup_join
from outskirt.operators.knn import PARTITION, exact_knn, reach_of
from outskirt.params import ScoreParams
from outskirt.plans.grid_plan import plan_nodes, range_names, slab_nodes
from outskirt.session import keep

OVERHANG_SCALE = 2


def side_names(p: ScoreParams) -> list[str]:
    return [f"ex_{name}" for name in range_names(p)]


def _edge(name: str, p: ScoreParams) -> str:
    """Coordinate of a box side given in cells."""
    return f"({lit(p.domain_min)} + {name} * {lit(p.cell_width)})"


def local_neighbors(points: DataFrame, plan: DataFrame, p: ScoreParams) -> DataFrame:
    """``id, c, pid, nid, nd, nc``: neighbours within the point's own partition."""
    found = exact_knn(points, p, PARTITION, plan)
    homes = plan.selectExpr("path as home", "pid")
    return lookup_join(found, homes, "home", _plan_bytes(p)).select("id", "c", "pid", "nid", "nd", "nc")


def _plan_bytes(p: ScoreParams) -> int:
    return 64 * p.dims * p.buckets**p.dims


def ball_status(local: DataFrame, plan: DataFrame, p: ScoreParams) -> DataFrame:
    """Add ``kdist``, ``status``, the overhang per box side and the distance to the box centre.

    Sides are compared as grid cells, which never disagree with the assignment. The
    domain's own edge is no border. With fewer than k neighbours the ball is unbounded.
    """
    boxes = plan.select("pid", *range_names(p))
    reach = reach_of("r", p)
    over, sides = [], []
    for i in range(p.dims):
        low = f"greatest({lit(p.domain_min)}, c[{i}] - {reach})"
        high = f"least({lit(p.domain_max)}, c[{i}] + {reach})"
        below = f"(lo{i} > 0 and {cell_index(low, p)} < lo{i})"
        above = f"(hi{i} < {p.cells} and {raw_cell_index(high, p)} >= hi{i})"
        over += [below, above]
        lo_gap, hi_gap = f"{_edge(f'lo{i}', p)} - {low}", f"{high} - {_edge(f'hi{i}', p)}"
        sides += [
            f"if({below}, greatest(0.0D, {round_up(lo_gap, OVERHANG_SCALE)}), 0.0D) as ex_lo{i}",
            f"if({above}, greatest(0.0D, {round_up(hi_gap, OVERHANG_SCALE)}), 0.0D) as ex_hi{i}",
        ]
    centre = box_centre(
        [_edge(f"lo{i}", p) for i in range(p.dims)], [_edge(f"hi{i}", p) for i in range(p.dims)]
    )
    pivot = l2(centre, [f"c[{i}]" for i in range(p.dims)], 2)
    return (
        lookup_join(local, boxes, "pid", _plan_bytes(p))
        .selectExpr("*", f"if(size(nid) >= {p.k}, element_at(nd, -1), double('inf')) as r")
        .selectExpr(
            *local.columns,
            "try_element_at(nd, -1) as kdist",
            f"if({' or '.join(over)}, 'F', 'T') as status",
            *sides,
            f"{pivot} as pivot_d",
        )
    )


def scan_order(status: DataFrame) -> DataFrame:
    """Rows of a partition together, farthest from its centre first, with ``place`` (from 1) in that order.

    The rows are range-sorted, so a partition may lie on several tasks; a row's place is its place in the task
    plus the rows of its partition in the tasks before (one row per task and partition).
    """
    order = ["pid", F.desc("pivot_d"), "id"]
    # Sorted rows are numbered in passing; kept, so that the numbers are fixed.
    rows = status.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(rows.withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("task", F.expr("shiftright(at, 33)"))
    first = rows.groupBy("pid", "task").agg(F.min("at").alias("first"), F.expr("count(1)").alias("n"))
    before = "sum(n) over (partition by pid order by task rows between unbounded preceding and 1 preceding)"
    first = first.selectExpr("pid", "task", f"coalesce({before}, 0) - first + 1 as shift")
    # A row per task and partition that meet: as many as Spark finds small enough are broadcast.
    return rows.join(first, ["pid", "task"]).selectExpr(
        *status.columns, "cast(at + shift as int) as place"
    )


def partition_expansion(status: DataFrame, plan: DataFrame, p: ScoreParams) -> DataFrame:
    """Plan boxes with the largest overhang of their ``F`` points on each side."""
    grown = status.where("status = 'F'").groupBy("pid").agg(*[F.max(s).alias(s) for s in side_names(p)])
    sides = [f"coalesce({s}, 0.0D) as {s}" for s in side_names(p)]
    # at most one row per box on both sides
    return lookup_join(plan, grown, "pid", _plan_bytes(p), "left").selectExpr("pid", *range_names(p), *sides)


def expanded_partitions(expansion: DataFrame, p: ScoreParams) -> DataFrame:
    """One row: the number of partitions that reach over any side."""
    return expansion.selectExpr(f"count_if(greatest({', '.join(side_names(p))}) > 0) as n")


def support_cells(expansion: DataFrame, p: ScoreParams) -> DataFrame:
    """``cell_id, pid``: cells of the expanded box outside the box; each pair once."""
    cells = expansion.where(f"greatest({', '.join(side_names(p))}) > 0")
    inside = []
    for i, name in enumerate(index_names(p)):
        w = lit(p.cell_width)
        first = f"cast(greatest(0, floor((lo{i} * {w} - ex_lo{i}) / {w})) as int)"
        last = f"cast(least({p.cells}, ceil((hi{i} * {w} + ex_hi{i}) / {w})) as int) - 1"
        cells = cells.selectExpr("*", f"explode(sequence({first}, {last})) as {name}")
        inside.append(f"{name} >= lo{i} and {name} < hi{i}")
    outside = cells.where(f"not ({' and '.join(inside)})")
    return outside.selectExpr(f"{cell_id(index_names(p), p.cells)} as cell_id", "pid").dropDuplicates(
        ["cell_id", "pid"]
    )


def support_slabs(expansion: DataFrame, p: ScoreParams) -> DataFrame:
    """``pid, lo0, hi0, ...``: the expanded box without the box, as at most two disjoint slabs per dimension, in cells.

    The slabs of dimension i lie below and above the box; before i they have the width of the box, after it that
    of the expanded box. No cell is listed.
    """
    w, first, last = lit(p.cell_width), [], []
    for i in range(p.dims):
        first.append(f"cast(greatest(0, floor((lo{i} * {w} - ex_lo{i}) / {w})) as int)")
        last.append(f"cast(least({p.cells}, ceil((hi{i} * {w} + ex_hi{i}) / {w})) as int)")
    slabs = []
    for i in range(p.dims):
        for own in ((first[i], f"lo{i}"), (f"hi{i}", last[i])):
            sides = [own if j == i else (f"lo{j}", f"hi{j}") if j < i else (first[j], last[j]) for j in range(p.dims)]
            slabs.append(f"named_struct({', '.join(f"'lo{j}', {a}, 'hi{j}', {b}" for j, (a, b) in enumerate(sides))})")
    some = " and ".join(f"lo{j} < hi{j}" for j in range(p.dims))
    return expansion.selectExpr("pid", f"inline(array({', '.join(slabs)}))").where(some)


def slab_points(points: DataFrame, slabs: DataFrame, plan: DataFrame, p: ScoreParams) -> DataFrame:
    """``id, c, pid, support_pid``: a copy of a point for every partition in whose slabs it lies.

    Slabs go down the plan to the boxes they reach; a point meets only those that reach its own box.
    """
    names = index_names(p)
    boxes = plan.selectExpr("path as node", "pid as own")
    size = 64 * p.dims * p.buckets**p.dims
    found = placed(points, p, "id", "c").select("id", "c", *names)
    homes = plan_nodes(points, plan, p).select("id", "node")
    found = lookup_join(found.join(homes, "id"), boxes, "node", size)
    reached = slab_nodes(slabs.selectExpr("pid as support_pid", *range_names(p)), plan, p)
    inside = " and ".join(f"{name} >= lo{d} and {name} < hi{d}" for d, name in enumerate(names))
    # A slab reaches at most all boxes.
    return found.join(reached, "node").where(inside).selectExpr("id", "c", "own as pid", "support_pid")


def support_lists(cells: DataFrame) -> DataFrame:
    """``cell_id, pids``: the supported partitions of a cell, ascending."""
    return cells.groupBy("cell_id").agg(F.expr("array_sort(collect_set(pid))").alias("pids"))


def support_points(assigned: DataFrame, cells: DataFrame, p: ScoreParams) -> DataFrame:
    """``id, c, pid, support_pid``: a copy of a point for every partition its cell supports."""
    size = p.cells**p.dims * (24 + 4 * p.buckets**p.dims)
    found = lookup_join(assigned, support_lists(cells), "cell_id", size)
    return found.selectExpr("id", "c", "pid", "explode(pids) as support_pid")


def points_with_support(points: DataFrame, cells: DataFrame, p: ScoreParams) -> DataFrame:
    """``id, c, pids``: every point once with the partitions it supports (maybe none)."""
    size = p.cells**p.dims * (24 + 4 * p.buckets**p.dims)
    found = lookup_join(with_cells(points, p), support_lists(cells), "cell_id", size, "left")
    return found.selectExpr("id", "c", "coalesce(pids, cast(array() as array<int>)) as pids")


def settlement(forces: DataFrame, p: ScoreParams, rows: int) -> DataFrame:
    """``id, pid, status`` with ``T`` refined to ``O`` or ``L``; input is ``id, pid, nid, lcf, status``."""
    known = forces.where("status = 'T'").selectExpr("id as nid", "true as known")
    pairs = forces.where("status = 'T'").selectExpr("id", "lcf", "explode(nid) as nid")
    ready = (
        lookup_join(pairs, known, "nid", 16 * rows, "left")
        .groupBy("id")
        .agg(F.expr("every(known is not null) or first(lcf) <= 1e-9D").alias("ready"))
        .where("ready")
    )
    return forces.join(ready, "id", "left").selectExpr(
        "id", "pid", "case when status = 'F' then 'F' when ready then 'O' else 'L' end as status"
    )
