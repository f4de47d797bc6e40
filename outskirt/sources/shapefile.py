"""Shapefile geometry (.shp): points, polylines, polygons, multipoints, with or without z / m.

With an index (.shx) beside it, a large file is read by several tasks (:mod:`outskirt.sources.ranges`)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outskirt.sources.geojson import layer_of

SHAPES = "path string, record bigint, type string, parts array<array<array<double>>>"
# Fixed values of the file format: shape type codes; z and m variants add 10 and 20.
_POINT, _POLYLINE, _POLYGON, _MULTIPOINT = 1, 3, 5, 8
HEADER_BYTES = 100
_BATCH = 2_000


def read_shapes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``layer, path, record, type, parts`` of every shape in all ``.shp`` files under the paths.

    ``layer`` is the file's directory name, ``record`` is unique within ``path``."""
    from outskirt.sources.ranges import ShapeSource, scan

    paths = [paths] if isinstance(paths, str) else paths
    found = [scan(spark, ShapeSource, path) for path in paths]
    return reduce(DataFrame.unionByName, found).withColumn("layer", layer_of("path"))


def parse_shapes(files: DataFrame) -> DataFrame:
    """``path, record, type, parts`` of the shapes in the binary column ``content``; ``path`` is passed on."""
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string").alias("path")
    return files.select("content", path).mapInPandas(_shapes, SHAPES)


def shape_vertices(shapes: DataFrame) -> DataFrame:
    """``lon, lat`` of every vertex."""
    return shapes.selectExpr("explode(flatten(parts)) as v").selectExpr("v[0] as lon", "v[1] as lat")


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "record", "type", "parts"]
    for batch in batches:
        for content, path in zip(batch["content"], batch["path"]):
            rows = []
            for row in records(content, HEADER_BYTES):
                rows.append((path, *row))
                if len(rows) == _BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def records(content: bytes, at: int = 0) -> Iterator[tuple[int, str, list]]:
    """(number, type, parts) of the records from ``at`` on."""
    while at + 12 <= len(content):
        number, words = struct.unpack_from(">ii", content, at)
        (code,) = struct.unpack_from("<i", content, at + 8)
        body, kind = at + 12, code % 10
        at += 8 + 2 * words
        if kind == _POINT:
            yield number, "Point", [[list(struct.unpack_from("<2d", content, body))]]
        elif kind == _MULTIPOINT:
            (n,) = struct.unpack_from("<i", content, body + 32)
            yield number, "MultiPoint", [_xy(content, body + 36, n)]
        elif kind in (_POLYLINE, _POLYGON):
            parts, n = struct.unpack_from("<2i", content, body + 32)
            starts = [*struct.unpack_from(f"<{parts}i", content, body + 40), n]
            xy = _xy(content, body + 40 + 4 * parts, n)
            rings = [xy[a:b] for a, b in zip(starts, starts[1:])]
            line = "LineString" if parts == 1 else "MultiLineString"
            yield number, "Polygon" if kind == _POLYGON else line, rings


def _xy(content: bytes, at: int, n: int) -> list[list[float]]:
    return np.frombuffer(content, "<f8", 2 * n, at).reshape(n, 2).tolist()
