"""Data-driven partition plan: grid cells grouped into boxes of near-equal count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.functions.cells import cell_id
from outskirt.operators.histogram import (
    cell_histogram,
    dimension_order,
    index_names,
    placed,
    slab_frequency,
)
from outskirt.operators.joins import lookup_join
from outskirt.params import ScoreParams
from outskirt.plans.cutter import equi_depth_cut
from outskirt.session import keep_small

# At most this many dimensions are cut.
CUT_DIMS = 10


def path_digits(p: ScoreParams) -> int:
    """Hexadecimal digits of a child's number in a path."""
    return max(2, len(f"{p.buckets - 1:x}"))


def range_names(p: ScoreParams) -> list[str]:
    return [name for d in range(p.dims) for name in (f"lo{d}", f"hi{d}")]


def partition_plan(points: DataFrame, p: ScoreParams, every: bool = False) -> DataFrame:
    """``pid, lo0, hi0, lo1, hi1, ..., n, path`` in cell units; the boxes tile the domain.

    ``path`` has two hexadecimal digits per cut (more beyond 256 buckets): boxes of one slab share their prefix.
    Without any point the plan is one box. Points outside the domain do not count; with ``every`` they
    count in the border cells.

    Only the cell histogram is cut, one dimension per step in order of uniformity, so
    the points are read once. A box with at most ``2k + 1`` points is not cut again.
    """
    histogram = keep_small(cell_histogram(points, p, every), p.cells**p.dims)
    order = dimension_order(slab_frequency(histogram, p), p)[:CUT_DIMS]
    everywhere = [f"{0 if name.startswith('lo') else p.cells} as {name}" for name in range_names(p)]
    cells = histogram.selectExpr("*", "'' as box")
    total = histogram.agg(F.expr("coalesce(sum(n), 0)").alias("n"))
    boxes = total.selectExpr("'' as box", *everywhere, "n")
    for level, dim in enumerate(order):
        limit = -1 if level == 0 else 2 * p.k + 1
        slabs = (
            cells.join(boxes.where(f"n > {limit}").select("box"), "box", "left_semi")
            .groupBy(F.col("box").alias("parent"), F.col(f"i{dim}").alias("slab"))
            .agg(F.sum("n").alias("n"))
        )
        runs = equi_depth_cut(slabs, p.buckets, p.k, p.cells).selectExpr(
            "parent as box", f"concat(parent, lpad(lower(hex(bucket)), {path_digits(p)}, '0')) as child", "lo", "hi", "n as new_n"
        )
        # an uncut box stays as it is; a box has at most `buckets` runs
        edges = {f"lo{dim}": "coalesce(lo, lo{d})", f"hi{dim}": "coalesce(hi, hi{d})"}
        ranges = [
            f"{edges[name].format(d=dim)} as {name}" if name in edges else name
            for name in range_names(p)
        ]
        boxes = boxes.join(runs, "box", "left").selectExpr(
            "box as parent", "coalesce(child, box) as box", *ranges, "coalesce(new_n, n) as n"
        )
        if level + 1 < len(order):
            boxes = keep_small(boxes, p.buckets ** (level + 1))
            routes = boxes.selectExpr("parent as box", "box as child", f"lo{dim} as lo", f"hi{dim} as hi")
            cells = (
                cells.join(routes, "box")
                .where(f"i{dim} >= lo and i{dim} < hi")
                .selectExpr(*index_names(p), "n", "child as box")
            )
    # numbering reads one row per box, at most buckets^dims
    numbered = f"row_number() over (order by {', '.join(range_names(p))}) - 1 as pid"
    return boxes.selectExpr(numbered, *range_names(p), "n", f"if(box = '', '{'0' * path_digits(p)}', box) as path")


def plan_cells(plan: DataFrame, p: ScoreParams) -> DataFrame:
    """``cell_id, pid``: every grid cell of every box."""
    cells = plan
    for d, name in enumerate(index_names(p)):
        cells = cells.selectExpr("*", f"explode(sequence(lo{d}, hi{d} - 1)) as {name}")
    return cells.selectExpr(f"{cell_id(index_names(p), p.cells)} as cell_id", "pid")


def plan_nodes(points: DataFrame, plan: DataFrame, p: ScoreParams, every: bool = False) -> DataFrame:
    """``id, c, i0, i1, ..., node``: the path of every point's plan box.

    Goes down the cuts, one join with the parents of a level each, in which a point meets one row and finds its child among the
    starts of the children; no cell is enumerated. With ``every``, border boxes reach to infinity, else points outside the domain are left out.
    """
    found = placed(points, p, "id", "c", every=every).selectExpr("*", "'' as node")
    names = index_names(p)
    for level in range(min(p.dims, CUT_DIMS)):
        parents = _children_of(plan, level, p)
        found = lookup_join(found, parents, "node", 64 * p.buckets ** (level + 1))
        below = f"size(filter(starts, s -> s <= array({', '.join(names)})[dim]))"
        found = found.selectExpr("id", "c", *names, f"kids[{below} - 1] as node")
    return found


def slab_nodes(slabs: DataFrame, plan: DataFrame, p: ScoreParams) -> DataFrame:
    """``slabs`` (with ``lo0, hi0, ...``) once for every plan box, its path in ``node``, that they reach into."""
    found = slabs.selectExpr("*", "'' as node")
    for level in range(min(p.dims, CUT_DIMS)):
        parents = _children_of(plan, level, p)
        ends = {side: f"array({', '.join(f'{side}{d}' for d in range(p.dims))})[dim]" for side in ("lo", "hi")}
        # A child ends where the next one starts.
        reached = f"(x, i) -> starts[i] < {ends['hi']} and (i + 1 >= size(starts) or get(starts, i + 1) > {ends['lo']})"
        found = lookup_join(found, parents, "node", 64 * p.buckets ** (level + 1))
        found = found.selectExpr(*slabs.columns, f"explode(filter(kids, {reached})) as node")
    return found


def _children_of(plan: DataFrame, level: int, p: ScoreParams) -> DataFrame:
    """``node, dim, starts, kids``: the boxes of a level, the dimension they are cut in, and their children in its order."""
    parent, child = (F.substring("path", 1, path_digits(p) * n) for n in (level, level + 1))
    starts = [F.min(f"lo{d}").alias(f"lo{d}") for d in range(p.dims)]
    kids = plan.groupBy(parent.alias("node"), child.alias("child")).agg(*starts)
    spread = ", ".join(f"max(lo{d}) > min(lo{d})" for d in range(p.dims))
    all_starts = f"array({', '.join(f'lo{d}' for d in range(p.dims))})"
    grouped = kids.groupBy("node").agg(
        # an uncut box is its own child: any dimension will do
        F.expr(f"greatest(array_position(array({spread}), true), 1) - 1").cast("int").alias("dim"),
        F.expr(f"collect_list(struct({all_starts} as at, child))").alias("k"),
    )
    ordered = grouped.selectExpr("node", "dim", "array_sort(transform(k, x -> struct(x.at[dim] as s, x.child as child))) as k")
    return ordered.selectExpr("node", "dim", "k.s as starts", "k.child as kids")


def assign_partitions(points: DataFrame, plan: DataFrame, p: ScoreParams) -> DataFrame:
    """``id, c, cell_id, pid``: the core partition of every point inside the domain."""
    nodes = plan_nodes(points, plan, p)
    pids = plan.selectExpr("path as node", "pid")
    return lookup_join(nodes, pids, "node", 64 * p.buckets**p.dims).selectExpr(
        "id", "c", f"{cell_id(index_names(p), p.cells)} as cell_id", "pid"
    )


def partition_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("pid").agg(F.expr("count(1)").alias("n"))
