"""Ingest jobs: read points, normalise them, write Parquet and the bounds file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outskirt.operators.points import bounds, normalize
from outskirt.session import keep
from outskirt.sources.geojson import read_geojson_points, write_geojson
from outskirt.sources.shapefile import read_shapes
from outskirt.sources.tables import read_csv_points, write_bounds, write_parquet


def normalize_columns(
    df: DataFrame, bounds_path: str, parquet_path: str, low: float = 0.0, high: float = 1.0, scale: int | None = 4
) -> DataFrame:
    """Scale all columns but the first, write bounds (CSV) and points (Parquet)."""
    limits = keep(bounds(df))
    write_bounds(limits, bounds_path)
    out = normalize(df, low=low, high=high, scale=scale, limits=limits)
    write_parquet(out, parquet_path)
    return df.sparkSession.read.parquet(parquet_path)


def normalize_geojson_points(
    spark: SparkSession, geojson: str | list[str], parquet_path: str, bounds_path: str
) -> DataFrame:
    return normalize_columns(read_geojson_points(spark, geojson), bounds_path, parquet_path)


def normalize_csv_points(
    spark: SparkSession, csv: str | list[str], parquet_path: str, bounds_path: str, schema: str | None = None
) -> DataFrame:
    return normalize_columns(read_csv_points(spark, csv, schema), bounds_path, parquet_path)


def shapefiles_to_geojson(spark: SparkSession, paths: str | list[str], geojson_path: str) -> None:
    """Shapefiles in any number of directories (layers) to GeoJSON text, a directory ``layer=...`` for each."""
    write_geojson(read_shapes(spark, paths), geojson_path)
