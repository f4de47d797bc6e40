"""Exact k nearest neighbours of every point.

1. a routing table sends every point to a box that a task can hold; one shuffle by box;
2. the task cuts its box into leaves and searches every point in the whole box;
3. a point whose ball stays inside the free space around its box is final;
4. the hull of a leaf's other balls names the boxes they reach; there they ask the leaves they touch;
5. a leaf meets its queries in chunks, and the lists are merged.

Only steps 4 and 5 cross box borders, and only for points near them.

In many dimensions nearly every ball reaches nearly every leaf. There the queries of step 4 go to whole boxes, a task's fill of them
at a time, so that a query is written once a box and not once a leaf, and neighbours' coordinates are looked up at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from outskirt.functions.numeric import lit
from outskirt.operators.blocks import ASK, LEAF, POINT, RESULT, asks_of, listed_dims, points_of, search_box, search_leaves, within_box
from outskirt.operators.copies import representatives, spread_to_copies
from outskirt.operators.joins import lookup_join
from outskirt.params import ScoreParams
from outskirt.plans.grid_plan import plan_nodes
from outskirt.plans.kd_tree import Routes, many_dims, routed, routing_table, task_rows
from outskirt.session import keep, task_count

GLOBAL, PARTITION = "global", "partition"


@dataclass
class Neighbors:
    """``table``: ``id, c, place, home, nid, nd, nc, settled`` per representative, with
    ``place`` only for the last one of a crowded location.

    ``home`` is the path of the plan box, within a partition.
    ``settled`` tells whether the own box already gave the final list. ``rows`` is the
    number of representatives, ``crowded`` that of locations with copies beyond them, ``extent`` the largest difference
    of two coordinates.
    """

    table: DataFrame
    rows: int
    crowded: int
    extent: float


@dataclass
class Leaves:
    """The searched leaves (a row of ``LEAF`` each), how they were routed, and how many points reach over their box."""

    table: DataFrame
    routes: Routes
    boxes: int
    open_points: int


def nearest_neighbors(
    points: DataFrame, p: ScoreParams, scope: str = GLOBAL, plan: DataFrame | None = None
) -> Neighbors:
    """Neighbours of the representatives of ``points`` (``id, c``).

    ``scope="partition"`` looks only inside the point's own plan box; ``plan`` has no effect otherwise.
    """
    seen = Observation()
    reps = keep(
        representatives(points, p.k, p.dims).observe(
            seen,
            F.expr("count(1)").alias("n"),
            F.expr(f"count_if(place = {p.k + 2})").alias("crowded"),
            F.expr("coalesce(max(array_max(c)) - min(array_min(c)), 0.0D)").alias("extent"),
        )
    )
    size = seen.get
    leaves = searched_leaves(reps, p, size["n"], plan if scope == PARTITION else None)
    point = leaves.table.select("ids", "cs", "home", "n", "nids", "nds", "ncs", "settled").mapInArrow(points_of(p), POINT)
    table = point.select("id", "c", "home", "nid", "nd", "nc", "settled")
    if leaves.open_points:
        across = _across_boxes if many_dims(p) else _across
        found = across(leaves, p).selectExpr("id", "cast(null as array<double>) as c", "cast(null as string) as home", "nid", "nd", "nc")
        near = table.where("not settled").drop("settled").unionByName(found)
        table = table.where("settled").unionByName(_merge(near, p))
    if many_dims(p):
        table = _with_coordinates(table, reps)
    if size["crowded"]:
        last = reps.where(f"place = {p.k + 2}").select("id", "place")
        table = lookup_join(table, last, "id", 16 * size["crowded"], "left")
    else:
        table = table.selectExpr("*", "cast(null as int) as place")
    return Neighbors(table.select("id", "c", "place", "home", "nid", "nd", "nc", "settled"), size["n"], size["crowded"], size["extent"])


def exact_knn(points: DataFrame, p: ScoreParams, scope: str = GLOBAL, plan: DataFrame | None = None) -> DataFrame:
    """``id, c, home, nid, nd, nc, settled`` for every point."""
    found = nearest_neighbors(points, p, scope, plan)
    table = keep(found.table) if found.crowded else found.table
    return spread_to_copies(points, table, p.k, found.crowded)


def reach_of(radius: str, p: ScoreParams) -> str:
    """:func:`outskirt.operators.blocks.slack` as SQL."""
    half = 0.0 if p.dist_scale is None else 0.5 * 10.0**-p.dist_scale
    return f"(({radius} + {lit(half)}) * {lit(1.0 + 1e-9)} + 1e-12D)"


def searched_leaves(reps: DataFrame, p: ScoreParams, rows: int, plan: DataFrame | None = None) -> Leaves:
    """Leaves of ``reps`` (``id, c``); with a ``plan``, each plan box is searched for itself."""
    spark = reps.sparkSession
    if plan is None:
        placed, groups = reps.selectExpr("id", "c", "'' as home"), [""]
    else:
        placed = keep(plan_nodes(reps, plan, p, every=True).selectExpr("id", "c", "node as home"))
        groups = [r["path"] for r in plan.select("path").collect()]
    tasks = spark.sparkContext.defaultParallelism
    routes, boxes = routing_table(placed, rows, groups, p, tasks)
    grouped = routed(placed, routes, p).repartition(task_count(spark, boxes), "box").groupBy("box")
    seen = Observation()
    table = keep(grouped.applyInArrow(within_box(p, routes), LEAF).observe(seen, F.expr("coalesce(sum(size(oids)), 0)").alias("n")))
    return Leaves(table, routes, boxes, seen.get["n"])


def asks(leaves: Leaves, p: ScoreParams) -> DataFrame:
    """``node, qids, qcs, qrs, m``: the queries of a leaf's open points to a leaf of another box, packed.

    A leaf has one row per box that the hull of its open balls reaches.
    """
    walk = leaves.table.where("size(touch) > 0").select("oids", "ocs", "ogs", "ors", F.explode("touch").alias("box"))
    packed = leaves.table.groupBy("box").agg(F.expr("collect_list(struct(node, lo, hi))").alias("k"))
    packed = packed.selectExpr("box", "k.node as nodes", "flatten(k.lo) as los", "flatten(k.hi) as his")
    met = walk.join(packed, "box").select("oids", "ocs", "ogs", "ors", "nodes", "los", "his")
    return met.mapInArrow(asks_of(p, leaves.routes), ASK)


def chunked(asked: DataFrame, p: ScoreParams) -> DataFrame:
    """``node, chunk, qids, qcs, qrs``: queries of a leaf in chunks of about ``leaf_rows``; a leaf that many ask is met in many."""
    crowded = asked.groupBy("node").agg(F.sum("m").alias("all")).where(f"all > {p.leaf_rows}")
    crowded = crowded.selectExpr("node", f"cast(ceil(all / {p.leaf_rows}D) as int) as chunks")
    spread = asked.join(crowded, "node", "left")
    spread = spread.withColumn("chunk", F.expr("coalesce(pmod(xxhash64(qids), chunks), 0)"))
    packed = spread.groupBy("node", "chunk").agg(F.expr("collect_list(struct(qids, qcs, qrs))").alias("q"))
    return packed.selectExpr("node", "chunk", "flatten(q.qids) as qids", "flatten(q.qcs) as qcs", "flatten(q.qrs) as qrs")


def _across(leaves: Leaves, p: ScoreParams) -> DataFrame:
    """``id, nid, nd, nc``: what the open points find in other boxes, at most one row per point and task."""
    blocks = chunked(keep(asks(leaves, p)), p).join(leaves.table.select("node", "ids", "cs"), "node")
    return blocks.select("qids", "qcs", "qrs", "ids", "cs").mapInArrow(search_leaves(p), RESULT)


def _across_boxes(leaves: Leaves, p: ScoreParams) -> DataFrame:
    """Like :func:`_across`, without coordinates: a box meets its queries in chunks of about what a task may hold."""
    spark = leaves.table.sparkSession
    walk = leaves.table.where("size(touch) > 0").select("node", "oids", "ocs", "ogs", "ors", F.explode("touch").alias("box"))
    asked = walk.groupBy("box").agg(F.expr(f"cast(ceil(sum(size(oids)) / {task_rows(p)}D) as int)").alias("chunks"))
    asked = keep(asked)
    # More than there are chunks, so that few tasks get several.
    tasks = task_count(spark, 3 * asked.agg(F.sum("chunks")).first()[0])
    walk = lookup_join(walk, asked, "box", 24 * leaves.boxes)
    walk = walk.selectExpr("box", "cast(pmod(xxhash64(node), chunks) as int) as chunk", "oids", "ocs", "ogs", "ors")
    boxes = lookup_join(leaves.table.select("box", "ids", "cs", "lo", "hi"), asked, "box", 24 * leaves.boxes)
    boxes = boxes.selectExpr("box", "explode(sequence(0, chunks - 1)) as chunk", "ids", "cs", "lo", "hi")
    walk, boxes = (t.repartition(tasks, "box", "chunk").groupBy("box", "chunk") for t in (walk, boxes))
    return walk.cogroup(boxes).applyInArrow(search_box(p, leaves.routes), RESULT)


def _with_coordinates(table: DataFrame, reps: DataFrame) -> DataFrame:
    """``table`` with the neighbours' coordinates ``nc``."""
    found = keep(table.drop("nc"))
    pairs = found.selectExpr("id", "posexplode(nid) as (j, nid)").join(reps.selectExpr("id as nid", "c as s"), "nid")
    lists = pairs.groupBy("id").agg(F.expr("flatten(transform(array_sort(collect_list(struct(j, s))), x -> x.s)) as nc"))
    return found.join(lists, "id", "left").withColumn("nc", F.expr("coalesce(nc, cast(array() as array<double>))"))


def _merge(near: DataFrame, p: ScoreParams) -> DataFrame:
    """The k best of all lists of a point, by distance, then id."""
    d = listed_dims(p)
    entries = (
        "if(size(nid) = 0, cast(array() as array<struct<nd:double,nid:bigint,nc:array<double>>>),"
        " transform(sequence(0, size(nid) - 1),"
        f" j -> named_struct('nd', nd[j], 'nid', nid[j], 'nc', slice(nc, j * {d} + 1, {d}))))"
    )
    return (
        near.selectExpr("id", "c", "home", f"{entries} as entries")
        .groupBy("id")
        .agg(
            F.first("c", ignorenulls=True).alias("c"),
            F.max("home").alias("home"),
            F.expr(f"slice(array_sort(flatten(collect_list(entries))), 1, {p.k})").alias("b"),
        )
        .selectExpr("id", "c", "home", "b.nid as nid", "b.nd as nd", "flatten(b.nc) as nc", "false as settled")
    )
