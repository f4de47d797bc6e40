import json
import struct

import numpy as np
import pytest
from pyspark.sql import Observation

from outskirt.ingest import normalize_csv_points, normalize_geojson_points, shapefiles_to_geojson
from outskirt.operators.points import as_points, normalize, sample_by_id, sample_random
from outskirt.params import ScoreParams
from outskirt.sources.geojson import read_geojson_points, read_lines, vertices
from outskirt.sources.ids import with_contiguous_id
from outskirt.sources.shapefile import read_shapes, shape_vertices
from outskirt.sources.tables import load_data, read_csv_points, read_parquet_points


def feature(kind, coordinates):
    return json.dumps({"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}})


def test_geojson_vertices(spark, tmp_path):
    (tmp_path / "roads").mkdir()
    (tmp_path / "parks").mkdir()
    (tmp_path / "roads" / "a.json").write_text(
        "\n".join([feature("Point", [1, 2, 9.5]), "{broken", feature("LineString", [[3, 4], [5, 6.5]]), "{}"])
    )
    (tmp_path / "parks" / "b.json").write_text(
        "\n".join(
            [
                feature("Polygon", [[[0, 0], [1, 0], [0, 0]], [[0.2, 0.2], [0.3, 0.2]]]),
                feature("MultiPolygon", [[[[7, 7]]]]),
            ]
        )
    )
    found = vertices(read_lines(spark, str(tmp_path)), "layer").collect()
    assert sorted((r.lon, r.lat) for r in found if r.layer == "roads") == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.5)]
    assert sorted((r.lon, r.lat) for r in found if r.layer == "parks") == [
        (0.0, 0.0), (0.0, 0.0), (0.2, 0.2), (0.3, 0.2), (1.0, 0.0)
    ]
    ids = [r.id for r in read_geojson_points(spark, str(tmp_path)).collect()]
    assert sorted(ids) == list(range(1, 9))


def test_ingest_geojson(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(feature("Point", [x, 7]) for x in (2, 3, 6)))
    out = normalize_geojson_points(spark, str(tmp_path / "in"), str(tmp_path / "p"), str(tmp_path / "b"))
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 0.0, 0.0), (2, 0.25, 0.0), (3, 1.0, 0.0)]
    assert spark.read.csv(str(tmp_path / "b")).collect()[0] == ("2.0", "6.0", "7.0", "7.0")


def test_csv(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    (tmp_path / "m.csv").write_text("a,b,label\n1,2.5,x\n3,4.5,y\n5,6.5,x\n")
    assert [tuple(r) for r in read_csv_points(spark, path).collect()] == [(0, 1, 2.5), (1, 3, 4.5), (2, 5, 6.5)]
    assert [tuple(r) for r in load_data(spark, path).collect()] == [(1, [1.0, 2.5]), (2, [3.0, 4.5]), (3, [5.0, 6.5])]
    out = normalize_csv_points(spark, path, str(tmp_path / "p"), str(tmp_path / "b"))
    assert [tuple(r)[1:] for r in out.orderBy("id").collect()] == [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)]
    points = read_parquet_points(spark, str(tmp_path / "p"), dims=1)
    assert points.columns == ["id", "a"]


def test_npy(spark, tmp_path):
    data = np.arange(12, dtype=np.int32).reshape(6, 2)
    np.save(tmp_path / "d.npy", data)
    found = load_data(spark, str(tmp_path / "d.npy")).orderBy("id").collect()
    assert [r.c for r in found] == data.astype(float).tolist() and found[-1].id == 6
    with pytest.raises(ValueError):
        load_data(spark, "x.txt")


def test_contiguous_ids_over_uneven_partitions(spark):
    df = spark.range(100).repartition(7, "id").where("id % 3 <> 0")
    ids = [r.id for r in with_contiguous_id(df.withColumnRenamed("id", "v")).collect()]
    assert sorted(ids) == list(range(1, 67))


def shp(*records):
    body = b""
    for number, shape in enumerate(records, 1):
        body += struct.pack(">ii", number, len(shape) // 2) + shape
    return bytes(100) + body


def test_shapefile(spark, tmp_path):
    box = struct.pack("<4d", 0, 0, 1, 1)
    point = struct.pack("<i2d", 1, 4.0, 5.0)
    line_z = struct.pack("<i", 13) + box + struct.pack("<2i", 1, 2) + struct.pack("<i4d", 0, 1, 2, 3, 4) + bytes(32)
    polygon = struct.pack("<i", 5) + box + struct.pack("<2i", 2, 5) + struct.pack("<2i", 0, 3) + struct.pack("<10d", *range(10))
    multi = struct.pack("<i", 8) + box + struct.pack("<i4d", 2, 6, 6, 7, 7)
    null = struct.pack("<i", 0)
    (tmp_path / "layer").mkdir()
    (tmp_path / "layer" / "a.shp").write_bytes(shp(point, line_z, null, polygon, multi))
    shapes = read_shapes(spark, str(tmp_path))
    assert [(r.record, r.type, len(r.parts)) for r in shapes.orderBy("record").collect()] == [
        (1, "Point", 1), (2, "LineString", 1), (4, "Polygon", 2), (5, "MultiPoint", 1)
    ]
    assert shape_vertices(shapes).count() == 1 + 2 + 5 + 2
    shapefiles_to_geojson(spark, str(tmp_path / "layer"), str(tmp_path / "json"))
    found = read_geojson_points(spark, str(tmp_path / "json"))
    assert found.count() == 1 + 2 + 5


def test_rejected_rows_are_counted(spark):
    rows = [(1, 5.0, 5.0), (2, None, 5.0), (3, float("nan"), 5.0), (4, 101.0, 5.0), (5, -0.1, 5.0), (6, 100.0, 0.0)]
    seen = Observation()
    points = as_points(spark.createDataFrame(rows, "id long, x double, y double"), ScoreParams(), seen)
    assert [r.id for r in points.collect()] == [1, 6]
    assert seen.get == {"rejected": 4}


def test_normalize(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0), (2, 4.0, 4.0), (3, 5.0, None)], "id long, x double, y double")
    assert [tuple(r)[1:] for r in normalize(df).collect()] == [(0.0, 0.0), (0.6667, 0.0), (1.0, None)]
    assert [r.x for r in normalize(df, ["x"], low=-1.0, high=1.0).collect()] == pytest.approx([-1.0, 0.3333, 1.0])


def test_samples(spark):
    df = spark.range(0, 100).selectExpr("id", "id / 7 as x")
    assert [r.id for r in sample_by_id(df, 25).collect()] == [0, 25, 50, 75]
    assert sample_by_id(df, 25).collect()[1].x == 3.57
    assert sample_random(df, 10).count() == 10 and sample_random(df, 10).collect() == sample_random(df, 10).collect()


def test_params_file(tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"general": {"k_nn": 4, "num_of_small_cells": 20, "domain_max": 1}}))
    p = ScoreParams.from_json(str(path), leaf_rows=64)
    assert (p.k, p.cells, p.domain_max, p.buckets, p.leaf_rows) == (4, 20, 1.0, 2, 64)
    with pytest.raises(ValueError):
        ScoreParams(k=0)
