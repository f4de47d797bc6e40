"""Queries over the given tables, one per operator."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outskirt.functions.cells import cell_indexes
from outskirt.functions.neighbors import edges, from_text, to_text
from outskirt.ingest import normalize_columns
from outskirt.job import result_rows, score_files, score_points
from outskirt.operators import support
from outskirt.operators.histogram import (
    cell_histogram,
    chi_square,
    index_names,
    slab_frequency,
    with_cells,
)
from outskirt.operators.knn import exact_knn
from outskirt.operators.points import array_points, as_points, bounds, normalize, rejections, sample_by_id, sample_random
from outskirt.operators.score import force_vectors, net_force, net_force_of
from outskirt.params import ScoreParams
from outskirt.plans.curve import core_ranges, merged, range_cells, range_points
from outskirt.plans.grid_plan import assign_partitions, partition_plan, partition_sizes, plan_cells
from outskirt.plans.quantile_plan import quantile_plan
from outskirt.session import keep, keep_small, scratch_path
from outskirt.sources.geojson import read_lines, vertices, write_geojson
from outskirt.sources.ids import with_contiguous_id
from outskirt.sources.ranges import shape_files, write_files
from outskirt.sources.shapefile import parse_shapes, read_shapes, shape_vertices
from outskirt.sources.tables import load_csv, load_npy, parse_npy, read_csv_points, read_parquet_points

P = ScoreParams(k=3)
WIDE = ScoreParams(k=5, dims=64, point_scale=None)
# Plans by quantiles: vectors cut in three of their dimensions, events into many parts of both.
WIDE_PLAN = WIDE.with_(domain_min=-1.0, domain_max=1.0, buckets=3)
FINE_PLAN = P.with_(buckets=300)


# -- point sets ---------------------------------------------------------------------


def customer_table(spark: SparkSession, sf: str) -> DataFrame:
    """``id, x, y``: account balance and total spend (summed in cents)."""
    orders = read_parquet_points(spark, f"{sf}/orders.parquet", columns=["o_custkey", "o_totalprice"])
    spend = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.expr("sum(floor(o_totalprice * 100.0D + 0.5D)) / 100.0D").alias("spend")
    )
    customers = read_parquet_points(spark, f"{sf}/customer.parquet", columns=["c_custkey", "c_acctbal"])
    return (
        customers.selectExpr("c_custkey as id", "c_acctbal as x")
        .join(spend, "id", "left")
        .selectExpr("id", "x", "coalesce(spend, 0.0D) as y")
    )


def part_table(spark: SparkSession, sf: str) -> DataFrame:
    parts = read_parquet_points(spark, f"{sf}/part.parquet", columns=["p_partkey", "p_size", "p_retailprice"])
    return parts.selectExpr("p_partkey as id", "cast(p_size as double) as x", "p_retailprice as y")


def event_table(spark: SparkSession, sf: str) -> DataFrame:
    """``id, x, y``: value and second of day."""
    events = read_parquet_points(spark, f"{sf}/events.parquet", columns=["event_id", "value", "ts"])
    second = "cast(hour(ts) * 3600 + minute(ts) * 60 + floor(extract(second from ts)) as double)"
    return events.selectExpr("event_id as id", "value as x", f"{second} as y")


def order_table(spark: SparkSession, sf: str) -> DataFrame:
    """``id, x, y``: price and day number."""
    orders = read_parquet_points(spark, f"{sf}/orders.parquet", columns=["o_orderkey", "o_totalprice", "o_orderdate"])
    day = "cast(datediff(o_orderdate, date'1970-01-01') as double)"
    return orders.selectExpr("o_orderkey as id", "o_totalprice as x", f"{day} as y")


def on_domain(table: DataFrame, p: ScoreParams = P) -> DataFrame:
    return as_points(normalize(table, low=p.domain_min, high=p.domain_max, scale=p.point_scale), p)


def customer_points(spark: SparkSession, sf: str) -> DataFrame:
    return on_domain(customer_table(spark, sf))


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    return on_domain(event_table(spark, sf))


def embedding_points(spark: SparkSession, sf: str) -> DataFrame:
    table = read_parquet_points(spark, f"{sf}/embeddings.parquet", columns=["vec_id", "embedding"])
    return array_points(table, "vec_id", "embedding")


# -- scans, projections, histogram ----------------------------------------------------


def point_bounds(spark, sf):
    return bounds(customer_table(spark, sf))


def point_normalize(spark, sf):
    return normalize(customer_table(spark, sf), high=100.0)


def sample_mod(spark, sf):
    return sample_by_id(event_table(spark, sf), 10)


def rejected_points(spark, sf):
    """Customers on a domain narrower than the data."""
    return rejections(customer_table(spark, sf), P.with_(domain_min=0.0, domain_max=500_000.0))


def sample_random_rows(spark, sf):
    """A third of the events, at random."""
    return sample_random(event_table(spark, sf), 3_333)


def cell_assign(spark, sf):
    return with_cells(event_points(spark, sf), P).select("id", *index_names(P), "cell_id")


def cell_decode(spark, sf):
    cells = with_cells(event_points(spark, sf), P).select("cell_id").distinct()
    decoded = [f"{ix} as i{d}" for d, ix in enumerate(cell_indexes("cell_id", P.dims, P.cells))]
    return cells.selectExpr("cell_id", *decoded)


def event_histogram(spark, sf):
    return cell_histogram(event_points(spark, sf), P)


def event_slabs(spark, sf):
    return slab_frequency(event_histogram(spark, sf), P)


def chi_square_dims(spark, sf):
    order = "row_number() over (order by chi2, dim) - 1 as place"  # one row per dimension
    return chi_square(event_slabs(spark, sf), P).selectExpr("dim", "chi2", order)


# -- partition plan -------------------------------------------------------------------


def event_plan(spark, sf):
    return partition_plan(event_points(spark, sf), P).drop("path")


def event_plan_cells(spark, sf):
    return plan_cells(partition_plan(event_points(spark, sf), P), P)


def plan_ranges(spark, sf):
    """Cells of the boxes' stretches of the Z-order curve."""
    plan = keep_small(partition_plan(event_points(spark, sf), P), P.buckets**P.dims)
    return range_cells(merged(core_ranges(plan, P)), plan, P)


def range_partitions(spark, sf):
    """Events with their plan boxes, by stretches of the Z-order curve."""
    points = event_points(spark, sf)
    return range_points(points, keep_small(partition_plan(points, P), P.buckets**P.dims), P)


def partition_coverage(spark, sf):
    points = event_points(spark, sf)
    return partition_sizes(assign_partitions(points, partition_plan(points, P), P))


def wide_plan(spark, sf):
    """The boxes of a plan over 64-d vectors, a row per box and dimension that it is cut in."""
    plan = quantile_plan(keep(embedding_points(spark, sf)), WIDE_PLAN, levels=3)
    boxes = plan.boxes.selectExpr("path", "n", "explode_outer(ranges) as r")
    return boxes.selectExpr("path", "n", "r.dim", "r.lo", "r.hi")


def fine_partitions(spark, sf):
    """Events with their boxes of a plan of 300 parts per dimension."""
    points = keep(event_points(spark, sf).repartition("id"))  # read many times, by all tasks
    return quantile_plan(points, FINE_PLAN).nodes(points)


class _Local:
    """Customer points, their plan, and neighbours within the partitions."""

    def __init__(self, spark, sf):
        self.points = keep(customer_points(spark, sf))
        self.plan = keep_small(partition_plan(self.points, P), P.buckets**P.dims)
        local = support.local_neighbors(self.points, self.plan, P)
        self.status = keep(support.ball_status(local, self.plan, P))
        self.expansion = support.partition_expansion(self.status, self.plan, P)


def local_knn_status(spark, sf):
    found = _Local(spark, sf).status
    return found.select("id", "pid", "kdist", "status", "pivot_d", *support.side_names(P))


def scan_order(spark, sf):
    return support.scan_order(_Local(spark, sf).status).select("pid", "id", "pivot_d", "place")


def expansion(spark, sf):
    return _Local(spark, sf).expansion


def expanded_count(spark, sf):
    return support.expanded_partitions(_Local(spark, sf).expansion, P)


def support_cell_lists(spark, sf):
    cells = support.support_cells(_Local(spark, sf).expansion, P)
    return support.support_lists(cells).selectExpr("cell_id", "array_join(pids, ',') as pids")


def support_copies(spark, sf):
    local = _Local(spark, sf)
    assigned = assign_partitions(local.points, local.plan, P)
    copies = support.support_points(assigned, support.support_cells(local.expansion, P), P)
    return copies.select("id", "pid", "support_pid")


CORNERS = ScoreParams(k=3, dims=5, buckets=2)


def corner_plan(spark: SparkSession) -> DataFrame:
    """A given plan: each of five dimensions halved, 32 boxes."""
    half = CORNERS.cells // 2
    side = [f"cast(shiftright(id, {4 - d}) & 1 as int)" for d in range(5)]
    ranges = [e for d in range(5) for e in (f"{side[d]} * {half} as lo{d}", f"({side[d]} + 1) * {half} as hi{d}")]
    path = ", ".join(f"'0', cast({x} as string)" for x in side)
    return spark.range(32).coalesce(1).selectExpr("cast(id as int) as pid", *ranges, "0L as n", f"concat({path}) as path")


def support_slabs(spark, sf):
    """Five dimensions: which partitions need a point, by slabs instead of cells."""
    table = read_parquet_points(spark, f"{sf}/embeddings.parquet", columns=["vec_id", "embedding"])
    five = [f"cast(embedding[{d}] as double) as x{d}" for d in range(5)]
    points = keep(on_domain(table.selectExpr("vec_id as id", *five), CORNERS))
    plan = keep_small(corner_plan(spark), 32)
    status = support.ball_status(support.local_neighbors(points, plan, CORNERS), plan, CORNERS)
    slabs = support.support_slabs(support.partition_expansion(status, plan, CORNERS), CORNERS)
    return support.slab_points(points, keep(slabs), plan, CORNERS).select("id", "pid", "support_pid")


def settlement(spark, sf):
    local = _Local(spark, sf)
    forces = keep(net_force(local.status, P).select("id", "pid", "nid", "lcf", "status"))
    return support.settlement(forces, P, forces.count())


def unsettled_points(spark, sf):
    """Points per partition that the first pass does not finish."""
    open_points = settlement(spark, sf).where("status <> 'O'")
    return open_points.groupBy("pid", "status").agg(F.expr("count(1)").alias("n"))


# -- neighbours and scores --------------------------------------------------------------


def l2_knn(spark, sf):
    return edges(exact_knn(embedding_points(spark, sf), WIDE), 64).select("id", "nid", "rank", "d")


def l1_knn(spark, sf):
    p = WIDE.with_(metric="l1")
    return edges(exact_knn(embedding_points(spark, sf), p), 64).select("id", "nid", "rank", "d")


def customer_knn(spark, sf):
    return edges(exact_knn(customer_points(spark, sf), P), 2).select("id", "nid", "rank", "d")


def k_distance(spark, sf):
    return exact_knn(customer_points(spark, sf), P).selectExpr("id", "element_at(nd, -1) as kdist")


def forces(spark, sf):
    return force_vectors(exact_knn(customer_points(spark, sf), P), P)


def customer_net_force(spark, sf):
    return net_force_of(forces(spark, sf), P)


def neighbor_list(spark, sf):
    """Neighbour lists through their text form and back, in hundredths."""
    knn = net_force(exact_knn(customer_points(spark, sf), P), P)
    entry = "named_struct('nid', nid[j], 'rank', j + 1, 'd', nd[j], 'kdist', kdist, 'lcf', lcf)"
    text = knn.selectExpr("id", f"{to_text(f'transform(sequence(0, size(nid) - 1), j -> {entry})')} as t")
    back = text.selectExpr("id", f"{from_text('t')} as nn")
    show = "concat(x.nid, ':', x.rank, ':', cast(round(x.d * 100) as bigint), ':', cast(round(x.lcf * 100) as bigint))"
    return back.selectExpr("id", f"array_join(transform(nn, x -> {show}), ',') as neighbors")


def customer_nof(spark, sf):
    return score_points(customer_points(spark, sf), P).select("id", "kdist", "lcf", "nof")


def part_nof(spark, sf):
    return score_points(on_domain(part_table(spark, sf)), P).select("id", "kdist", "lcf", "nof")


def supplier_nof(spark, sf):
    """One dimension: account balance of suppliers."""
    p = P.with_(dims=1)
    table = read_parquet_points(spark, f"{sf}/supplier.parquet", columns=["s_suppkey", "s_acctbal"])
    return score_points(on_domain(table, p), p).select("id", "kdist", "lcf", "nof")


def shown(rows: DataFrame) -> DataFrame:
    """Full result rows, neighbour text decoded, numbers in hundredths."""
    show = "concat_ws(':', x.rank, x.nid, cast(round(x.d * 100) as bigint), cast(round(x.f[0] * 10000) as bigint), cast(round(x.kdist * 100) as bigint), cast(round(x.lcf * 100) as bigint))"
    return rows.selectExpr(
        "id", "c[0] as x", "c[1] as y", "pid", "status", "kdist", "lcf", "nof",
        f"array_join(transform({from_text('neighbors')}, x -> {show}), ',') as neighbors",
        "array_join(supports, ',') as supports",
    )


def result(spark, sf):
    return shown(result_rows(customer_points(spark, sf), P))


def scored_files(spark, sf):
    """The whole job from Parquet to Parquet, with full result rows, read back."""
    source, target = scratch_path(spark, "points"), scratch_path(spark, "scores")
    normalize(customer_table(spark, sf), low=P.domain_min, high=P.domain_max, scale=P.point_scale).write.parquet(source)
    score_files(spark, source, target, P, detail=True)
    return shown(spark.read.parquet(target))


def order_nof(spark, sf):
    return score_points(on_domain(order_table(spark, sf)), P).select("id", "kdist", "lcf", "nof")


def order_far_nof(spark, sf):
    """Orders as they are, on a domain as wide as the data: forces leave the BIGINT range."""
    p = P.with_(domain_max=1_000_000.0)
    return score_points(as_points(order_table(spark, sf), p), p).select("id", "kdist", "lcf", "nof")


def outside_nof(spark, sf):
    """Customers with a domain that most of them lie outside of: the search keeps every row."""
    p = P.with_(domain_min=40.0, domain_max=60.0)
    return score_points(customer_points(spark, sf), p).select("id", "kdist", "lcf", "nof")


def event_nof(spark, sf):
    return score_points(event_points(spark, sf), P).select("id", "kdist", "lcf", "nof")


# -- file sources -------------------------------------------------------------------------


def customer_shapes(spark, sf):
    """A point, a line and a polygon with a hole for every customer."""
    return shapes_of(customer_table(spark, sf))


def shapes_of(table: DataFrame) -> DataFrame:
    a, b = "array(x, y)", "array(x + 1, y + 2)"
    ring, hole = f"array({a}, {b}, array(x, y + 2), {a})", f"array({a}, {b}, {a})"
    return (
        table.selectExpr(
            "explode(array("
            f"named_struct('type', 'Point', 'parts', array(array({a}))),"
            f"named_struct('type', 'LineString', 'parts', array(array({a}, {b}))),"
            f"named_struct('type', 'Polygon', 'parts', array({ring}, {hole}))"
            ")) as s"
        )
        .select("s.*")
    )


def geojson_vertices(spark, sf):
    folder = scratch_path(spark, "geojson") + "/customers"
    write_geojson(customer_shapes(spark, sf), folder)
    found = vertices(read_lines(spark, folder), "layer")
    return found.groupBy("layer", "lon", "lat").agg(F.expr("count(1)").alias("n"))


def geojson_layers(spark, sf):
    """Two layers written at once, each to its own directory, and read back."""
    suppliers = read_parquet_points(spark, f"{sf}/supplier.parquet", columns=["s_suppkey", "s_acctbal", "s_nationkey"])
    suppliers = suppliers.selectExpr("s_suppkey as id", "s_acctbal as x", "cast(s_nationkey as double) as y")
    both = customer_shapes(spark, sf).withColumn("layer", F.lit("customers"))
    both = both.unionByName(shapes_of(suppliers).withColumn("layer", F.lit("suppliers")))
    folder = scratch_path(spark, "geojson")
    write_geojson(both, folder)
    found = vertices(read_lines(spark, folder), "layer")
    return found.groupBy("layer", "lon", "lat").agg(F.expr("count(1)").alias("n"))


def contiguous_ids(spark, sf):
    folder = scratch_path(spark, "geojson") + "/customers"
    write_geojson(customer_shapes(spark, sf), folder)
    found = with_contiguous_id(vertices(read_lines(spark, folder)))
    return found.selectExpr(
        "count(1) as n", "min(id) as first_id", "max(id) as last_id", "count(distinct id) as ids"
    )


def _part_csv(spark, sf):
    folder = scratch_path(spark, "csv")
    part_table(spark, sf).selectExpr("x", "y", "id as label").write.option("header", True).csv(folder)
    return folder


def csv_points(spark, sf):
    found = read_csv_points(spark, _part_csv(spark, sf))
    ids = found.selectExpr("count(distinct id)").scalar()
    rows = found.groupBy("x", "y").agg(F.expr("count(1)").alias("n"))
    return rows.withColumn("ids", ids)


def _with_ids(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the smallest, the largest and the number of different ids of ``found``."""
    ids = found.selectExpr("min(id) as first_id", "max(id) as last_id", "count(distinct id) as ids")
    return rows.withColumns({c: ids.select(c).scalar() for c in ids.columns})


def csv_load(spark, sf):
    found = load_csv(spark, _part_csv(spark, sf))
    rows = found.selectExpr("c[0] as x", "c[1] as y").groupBy("x", "y").agg(F.expr("count(1)").alias("n"))
    return _with_ids(found, rows)


def csv_normalize(spark, sf):
    """The whole ingest of a CSV: bounds file, scaling to [0, 1], Parquet."""
    table = read_csv_points(spark, _part_csv(spark, sf), "x double, y double, label bigint")
    limits, points = scratch_path(spark, "bounds"), scratch_path(spark, "points")
    done = normalize_columns(table, limits, points)
    edge = spark.read.schema("min_x double, max_x double, min_y double, max_y double").csv(limits)
    # the bounds file has one row
    rows = done.groupBy("x", "y").agg(F.expr("count(1)").alias("n"))
    return rows.withColumns({c: edge.select(c).scalar() for c in edge.columns})


def npy_points(spark, sf):
    def pack(batches):
        for pdf in batches:
            out = io.BytesIO()
            np.save(out, pdf[["x", "y"]].to_numpy())
            yield pd.DataFrame({"content": [out.getvalue()]})

    files = part_table(spark, sf).mapInPandas(pack, "content binary")
    found = with_contiguous_id(parse_npy(files))
    rows = found.selectExpr("c[0] as x", "c[1] as y").groupBy("x", "y").agg(F.expr("count(1)").alias("n"))
    return _with_ids(found, rows)


def shapefile_vertices(spark, sf):
    """Polyline shapefiles made in the tasks, one per batch of customers."""

    def pack(batches):
        for pdf in batches:
            body = b""
            for number, (x, y) in enumerate(zip(pdf["x"], pdf["y"]), 1):
                shape = struct.pack("<i4d3i", 3, x, y, x + 1, y + 2, 1, 2, 0)
                shape += struct.pack("<4d", x, y, x + 1, y + 2)
                body += struct.pack(">ii", number, len(shape) // 2) + shape
            yield pd.DataFrame({"content": [bytes(100) + body]})

    files = customer_table(spark, sf).mapInPandas(pack, "content binary")
    found = shape_vertices(parse_shapes(files))
    return found.groupBy("lon", "lat").agg(F.expr("count(1)").alias("n"))


def _written(table: DataFrame, folder: str, parts_of) -> None:
    """A file (and its index) per task below ``folder``."""

    def run(batches):
        from pyspark import TaskContext

        for number, pdf in enumerate(batches):
            name = f"part-{TaskContext.get().partitionId():05d}-{number:05d}"
            write_files(folder, name, parts_of(pdf))
            yield pd.DataFrame({"rows": [len(pdf)]})

    table.mapInPandas(run, "rows bigint").write.format("noop").mode("overwrite").save()


def _npy_file(pdf: pd.DataFrame) -> dict[str, bytes]:
    out = io.BytesIO()
    np.save(out, pdf[["x", "y"]].to_numpy())
    return {".npy": out.getvalue()}


def npy_files(spark, sf):
    """NPY files in the shared folder, scanned in ranges."""
    folder = scratch_path(spark, "npy")
    _written(part_table(spark, sf), folder, _npy_file)
    found = load_npy(spark, folder)
    rows = found.selectExpr("c[0] as x", "c[1] as y").groupBy("x", "y").agg(F.expr("count(1)").alias("n"))
    return _with_ids(found, rows)


def _shape_file(pdf: pd.DataFrame) -> dict[str, bytes]:
    """A point, a line and a polygon with a hole of each row, as :func:`shapes_of` has them."""

    def rings(code: int, *parts: list) -> tuple[int, bytes]:
        points = [v for part in parts for v in part]
        starts = np.cumsum([0, *map(len, parts[:-1])])
        box = np.array(points)
        head = struct.pack("<4d2i", *box.min(axis=0), *box.max(axis=0), len(parts), len(points))
        return code, head + struct.pack(f"<{len(parts)}i", *starts) + box.astype("<f8").tobytes()

    shapes = []
    for x, y in zip(pdf["x"], pdf["y"]):
        a, b = (x, y), (x + 1, y + 2)
        shapes += [(1, struct.pack("<2d", x, y)), rings(3, [a, b]), rings(5, [a, b, (x, y + 2), a], [a, b, a])]
    return shape_files(shapes)


def shapefile_layers(spark, sf):
    """Shapefiles with points, lines and polygons in the shared folder, scanned by their index."""
    folder = scratch_path(spark, "shapes")
    _written(customer_table(spark, sf), f"{folder}/customers", _shape_file)
    shapes = read_shapes(spark, folder)
    found = shapes.selectExpr("layer", "explode(flatten(parts)) as v").selectExpr("layer", "v[0] as lon", "v[1] as lat")
    return found.groupBy("layer", "lon", "lat").agg(F.expr("count(1)").alias("n"))


QUERIES = {
    "point_bounds": point_bounds,
    "point_normalize": point_normalize,
    "sample_mod": sample_mod,
    "sample_random": sample_random_rows,
    "rejected_points": rejected_points,
    "cell_assign": cell_assign,
    "cell_decode": cell_decode,
    "cell_histogram": event_histogram,
    "slab_frequency": event_slabs,
    "chi_square_dims": chi_square_dims,
    "partition_plan": event_plan,
    "plan_cells": event_plan_cells,
    "plan_ranges": plan_ranges,
    "range_partitions": range_partitions,
    "quantile_plan": wide_plan,
    "quantile_partitions": fine_partitions,
    "partition_coverage": partition_coverage,
    "local_knn_status": local_knn_status,
    "scan_order": scan_order,
    "partition_expansion": expansion,
    "expanded_partitions": expanded_count,
    "support_cells": support_cell_lists,
    "support_points": support_copies,
    "support_slabs": support_slabs,
    "settlement": settlement,
    "unsettled_points": unsettled_points,
    "l2_knn": l2_knn,
    "l1_knn": l1_knn,
    "exact_knn": customer_knn,
    "k_distance": k_distance,
    "force_vectors": forces,
    "net_force": customer_net_force,
    "neighbor_list": neighbor_list,
    "customer_nof": customer_nof,
    "part_nof": part_nof,
    "supplier_nof": supplier_nof,
    "result_rows": result,
    "scored_files": scored_files,
    "order_nof": order_nof,
    "event_nof": event_nof,
    "order_far_nof": order_far_nof,
    "outside_nof": outside_nof,
    "geojson_vertices": geojson_vertices,
    "geojson_layers": geojson_layers,
    "contiguous_ids": contiguous_ids,
    "csv_points": csv_points,
    "csv_load": csv_load,
    "csv_normalize": csv_normalize,
    "npy_points": npy_points,
    "shapefile_vertices": shapefile_vertices,
    "npy_files": npy_files,
    "shapefile_layers": shapefile_layers,
}
