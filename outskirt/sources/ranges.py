"""NPY arrays and shapefiles as Spark data sources whose files are read in byte ranges, several tasks to a large file.

Rows of an NPY array all have one size, so its header tells where any row is. A shapefile's index (.shx) tells it of every record.
Files are listed and opened by pyarrow's file systems, on the driver to plan and in the tasks to read.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from outskirt.sources.shapefile import HEADER_BYTES, SHAPES, records

#: Bytes that a task should read of a file, and rows or shapes of a batch.
RANGE_BYTES = 32 << 20
BATCH = 20_000


@dataclass
class Range(InputPartition):
    """Rows (or records) ``start`` to ``end`` of a file that has ``size`` bytes; all of a file that can't be read in part if ``end`` < 0."""

    path: str
    size: int
    start: int = 0
    end: int = -1


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def files_below(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files with the ending below a directory, in order of their paths."""
    store, root = opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.Directory:
        found = [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(ending)]
    else:
        found = [info] if info.is_file else []
    scheme = path[: path.index(root)] if root and root in path else ""
    return sorted((scheme + i.path, i.size) for i in found)


def _read(path: str, at: int, n: int | None = None) -> bytes:
    store, own = opened(path)
    with store.open_input_file(own) as file:
        file.seek(at)
        return file.read() if n is None else file.read(n)


@dataclass
class _Header:
    rows: int
    kind: np.dtype
    width: int
    at: int
    by_rows: bool


def _header(path: str) -> _Header:
    head = io.BytesIO(_read(path, 0, 1 << 16))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_columns, kind = read(head)
    if kind.hasobject:
        raise ValueError(f"{path}: an array of objects")
    shape = shape if len(shape) > 1 else (1, shape[0] if shape else 1)  # as numpy.atleast_2d
    return _Header(shape[0], kind, int(np.prod(shape[1:])), head.tell(), not by_columns)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("range_bytes", RANGE_BYTES))


class _NpyReader(_Reader):
    def partitions(self) -> list[Range]:
        out = []
        for path, size in files_below(self.path, ".npy"):
            h = _header(path)
            step = max(1, self.bytes // max(1, h.width * h.kind.itemsize)) if h.by_rows else h.rows
            out += [Range(path, size, a, min(a + step, h.rows)) for a in range(0, h.rows, max(step, 1))]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:
            return
        h = _header(part.path)
        if h.by_rows:
            n, row = part.end - part.start, h.width * h.kind.itemsize
            rows = np.frombuffer(_read(part.path, h.at + part.start * row, n * row), dtype=h.kind).reshape(n, h.width)
        else:  # stored by columns: one task
            rows = np.load(io.BytesIO(_read(part.path, 0)), allow_pickle=False).reshape(h.rows, h.width)
        for begin in range(0, len(rows), BATCH):
            some = np.ascontiguousarray(rows[begin : begin + BATCH], dtype=np.float64)
            ends = np.arange(len(some) + 1, dtype=np.int32) * h.width
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(some.ravel()))], names=["c"])


class NpySource(DataSource):
    """``c``: the rows of all 2-D arrays below ``path``; a 1-D array is one row."""

    @classmethod
    def name(cls) -> str:
        return "outskirt_npy"

    def schema(self) -> str:
        return "c array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


class _ShapeReader(_Reader):
    def partitions(self) -> list[Range]:
        out, index = [], dict(files_below(self.path, ".shx"))
        for path, size in files_below(self.path, ".shp"):
            shx = path[:-1] + "x"
            n = (index.get(shx, 0) - HEADER_BYTES) // 8
            if n < 1:
                out.append(Range(path, size))
                continue
            step = max(1, n * self.bytes // max(size, 1))
            out += [Range(path, size, a, min(a + step, n)) for a in range(0, n, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:
            return
        begin, end = HEADER_BYTES, part.size
        if part.end > 0:
            index = np.frombuffer(_read(part.path[:-1] + "x", HEADER_BYTES + 8 * part.start, 8 * (part.end - part.start)), dtype=">i4")
            offset, words = index.reshape(-1, 2).T.astype(np.int64)
            begin, end = int(2 * offset.min()), int((2 * offset + 8 + 2 * words).max())
        held: list[tuple] = []
        for row in records(_read(part.path, begin, end - begin)):
            held.append((part.path, *row))
            if len(held) == BATCH:
                yield _shape_batch(held)
                held = []
        if held:
            yield _shape_batch(held)


def _shape_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.list_(pa.float64()))))
    columns = [pa.array(v, type=t) for v, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "record", "type", "parts"])


class ShapeSource(DataSource):
    """``path, record, type, parts`` of the shapes in all .shp files below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "outskirt_shp"

    def schema(self) -> str:
        return SHAPES

    def reader(self, schema) -> DataSourceReader:
        return _ShapeReader(self.options)


def scan(spark: SparkSession, source: type[DataSource], path: str) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("path", path).option("range_bytes", RANGE_BYTES).load()


# -- writing, a file per task -----------------------------------------------------------


def write_files(folder: str, name: str, parts: dict[str, bytes]) -> None:
    """``parts``: contents by ending, below ``folder``; each replaced whole, so that a task may run again."""
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    for ending, content in parts.items():
        with store.open_output_stream(f"{root}/_{name}{ending}.part") as file:
            file.write(content)
        store.move(f"{root}/_{name}{ending}.part", f"{root}/{name}{ending}")


def shape_files(shapes: list[tuple[int, bytes]]) -> dict[str, bytes]:
    """``.shp`` and ``.shx`` of (type code, body without the code)."""
    body, index = [], []
    at = HEADER_BYTES
    for number, (code, rest) in enumerate(shapes, 1):
        content = struct.pack("<i", code) + rest
        index.append(struct.pack(">ii", at // 2, len(content) // 2))
        body.append(struct.pack(">ii", number, len(content) // 2) + content)
        at += 8 + len(content)
    return {".shp": bytes(HEADER_BYTES) + b"".join(body), ".shx": bytes(HEADER_BYTES) + b"".join(index)}
