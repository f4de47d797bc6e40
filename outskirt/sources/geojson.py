"""GeoJSON lines: one Feature per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outskirt.sources.ids import with_contiguous_id

_FEATURE = "geometry struct<type:string,coordinates:string>"
# Geometry type and the array type of its coordinates.
_VERTICES = {
    "Point": "array(from_json(coordinates, 'array<double>'))",
    "LineString": "from_json(coordinates, 'array<array<double>>')",
    "Polygon": "flatten(from_json(coordinates, 'array<array<array<double>>>'))",
}


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """``value, layer`` of all files under the paths; ``layer`` is the file's directory name."""
    lines = spark.read.option("recursiveFileLookup", recursive).text(paths)
    return lines.select("value", layer_of("_metadata.file_path").alias("layer"))


def layer_of(path: str) -> Column:
    """The name of the directory that a file is in, less the ``layer=`` of a partitioned one."""
    return F.regexp_replace(F.regexp_extract(F.col(path), "([^/]+)/[^/]+$", 1), "^layer=", "")


def vertices(lines: DataFrame, *keep: str) -> DataFrame:
    """``lon, lat`` of every vertex; broken lines and other geometry types give no row."""
    cases = " ".join(f"when '{kind}' then {vertex}" for kind, vertex in _VERTICES.items())
    return (
        lines.selectExpr(*keep, f"from_json(value, '{_FEATURE}').geometry as g")
        .selectExpr(*keep, "g.type as type", "g.coordinates as coordinates")
        .selectExpr(*keep, f"explode(case type {cases} end) as v")
        .selectExpr(*keep, "try_element_at(v, 1) as lon", "try_element_at(v, 2) as lat")
        .where("lon is not null and lat is not null")
    )


def read_geojson_points(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """``id, lon, lat`` with ids 1, 2, 3, ..."""
    return with_contiguous_id(vertices(read_lines(spark, paths, recursive)))


def write_geojson(shapes: DataFrame, path: str) -> None:
    """Write ``type, parts`` (``parts``: lists of vertices) as one Feature per line.

    With a column ``layer`` each layer gets a directory ``layer=...`` of its own."""
    writer = features(shapes).write.mode("overwrite")
    (writer.partitionBy("layer") if "layer" in shapes.columns else writer).text(path)


def features(shapes: DataFrame) -> DataFrame:
    """``value``: GeoJSON text of each shape, and its ``layer`` if it has one."""
    coordinates = (
        "case when type = 'Point' then to_json(parts[0][0])"
        " when type in ('LineString', 'MultiPoint') then to_json(parts[0])"
        " else to_json(parts) end"
    )
    kept = ["layer"] if "layer" in shapes.columns else []
    return shapes.selectExpr(
        *kept, "concat('{\"type\":\"Feature\",\"geometry\":{\"type\":\"', type, '\",\"coordinates\":', "
        f"{coordinates}, '}},\"properties\":{{}}}}') as value"
    )
