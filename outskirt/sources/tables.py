"""Point tables in Parquet, CSV and NPY files."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from outskirt.sources.ids import with_contiguous_id, with_sparse_id

_NPY_ROWS = 50_000


def read_parquet_points(
    spark: SparkSession, path: str | Sequence[str], dims: int | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """A positional point table: id first, then coordinates; only those columns are read."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if columns is not None:
        return df.select(*columns)
    return df if dims is None else df.select(*df.columns[: dims + 1])


def read_csv_points(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header whose last column is a label: label dropped, sparse id put first.

    Types are inferred (one more pass) unless a ``schema`` is given.
    """
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return with_sparse_id(df.select(*df.columns[:-1]))


def load_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header to ``id, c``: label dropped, values as doubles, ids 1, 2, 3, ..."""
    df = spark.read.option("header", True).csv(path)
    values = ", ".join(f"cast(`{c}` as double)" for c in df.columns[:-1])
    return with_contiguous_id(df.selectExpr(f"array({values}) as c"))


def load_npy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """2-D NPY arrays to ``id, c`` with ids 1, 2, 3, ... in the order of paths; files are read in ranges, in the tasks."""
    from outskirt.sources.ranges import NpySource, scan

    found = [scan(spark, NpySource, one) for one in ([path] if isinstance(path, str) else path)]
    return with_contiguous_id(reduce(DataFrame.unionByName, found))


def parse_npy(files: DataFrame) -> DataFrame:
    """``c``: the rows of the NPY arrays in the binary column ``content``."""
    return files.select("content").mapInArrow(_npy_rows, "c array<double>")


def load_data(spark: SparkSession, path: str) -> DataFrame:
    """``id, c`` from a CSV or NPY file, by its ending."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return load_csv(spark, path)
    if ending == "npy":
        return load_npy(spark, path)
    raise ValueError(f"cannot load {path}: neither .csv nor .npy")


def _npy_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
            rows = np.atleast_2d(rows).astype(np.float64)
            for start in range(0, len(rows), _NPY_ROWS):
                part = np.ascontiguousarray(rows[start : start + _NPY_ROWS])
                ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                c = pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([c], names=["c"])


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_bounds(bounds: DataFrame, path: str) -> None:
    """The one row ``min, max, min, max, ...`` without a header."""
    bounds.write.mode("overwrite").csv(path)
