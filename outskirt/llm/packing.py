"""Packing in space-filling-curve order.

1. Tokenize: per document its ids (two bytes each while the vocabulary allows) and a Hilbert key: the ids'
   random signs in ``DIMS`` dimensions are averaged, squashed to a grid, and the grid cell's place on the
   Hilbert curve is the key. Similar documents get near keys. This table is written once.
2. Range-sort the narrow part by (key, doc_id, row), number the ids within each range, and add the
   totals of the ranges before it (one row per range). A document's place in the endless
   sequence of all ids is now known.
3. Cut that sequence every ``length`` ids: only the very last sequence has padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outskirt.llm.shared import shared_folder, stored, width
from outskirt.llm.tokens import U, mix

DIMS, BITS = 4, 12
#: Mean signs of about this size fall half-way between the middle and the border of the grid.
SQUASH = 0.05


def signs(vocabulary: int) -> np.ndarray:
    """+1 or -1 for each id and dimension."""
    bits = mix(np.arange(1, vocabulary + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return np.stack([((bits >> U(d)) & U(1)).astype(np.float32) * 2 - 1 for d in range(DIMS)], axis=1)


def grid(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    mean = table[ids].mean(axis=0, dtype=np.float64)
    return np.minimum(((mean / (np.abs(mean) + SQUASH) + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(cells: np.ndarray) -> np.ndarray:
    """Places on the Hilbert curve of the rows of ``cells`` (n, DIMS), each below 2^BITS (Skilling 2004)."""
    x = cells.T.astype(np.int64).copy()
    q = 1 << (BITS - 1)
    while q > 1:
        low = q - 1
        for i in range(DIMS):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, DIMS):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where((x[DIMS - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(BITS - 1, -1, -1):
        for i in range(DIMS):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Tokenizer:
    """Byte-level BPE of a rank file; loaded once per Python worker."""

    loaded: dict = {}

    @classmethod
    def at(cls, path: str, pattern: str):
        if path not in cls.loaded:
            import base64

            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            cls.loaded[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return cls.loaded[path]


class WholeTokenizer:
    """The same vocabulary as a JSON file, for texts that the other fails on; loaded once per Python worker, when needed."""

    loaded: dict = {}

    @classmethod
    def at(cls, path: str):
        if path not in cls.loaded:
            import tokenizers

            cls.loaded[path] = tokenizers.Tokenizer.from_file(path)
            # As in the rank file's encode_ordinary: strings of special tokens are ordinary text.
            cls.loaded[path].encode_special_tokens = True
        return cls.loaded[path]


def encoder(path: str, pattern: str, json_file: str):
    """Text to ids by the rank file; by the JSON file where that fails (white space in runs of about a million)."""
    ordinary = Tokenizer.at(path, pattern).encode_ordinary

    def encode(text: str) -> list[int]:
        try:
            return ordinary(text)
        except (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError):
            raise
        except BaseException:  # a panic is no Exception
            return WholeTokenizer.at(json_file).encode(text, add_special_tokens=False).ids

    return encode


def _tokenize(path: str, pattern: str, json_file: str, end_id: int, wide: bool, vocabulary: int, text_at: int):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches):
        encode = encoder(path, pattern, json_file)
        table = signs(vocabulary)
        for batch in batches:
            # Batches are cut so that the ids of few documents are held at once.
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, cells = [], []
                for text in part.column(text_at):
                    own = np.array([*encode(text.as_py() or ""), end_id], dtype=np.int64)
                    cells.append(grid(own, table))
                    ids.append(own.astype(kind).tobytes())
                n = [len(x) // kind.itemsize for x in ids]
                others = [c for i, c in enumerate(part.columns) if i != text_at]
                names = [c for i, c in enumerate(part.schema.names) if i != text_at]
                columns = [pa.array(ids, type=pa.binary()), pa.array(n, type=pa.int64()), pa.array(hilbert(np.array(cells)))]
                yield pa.RecordBatch.from_arrays([*others, *columns], names=[*names, "__ids", "__n", "__key"])

    return run


def _place(batches):
    """Number the ids within the partition: rows (row, part, at)."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = before + np.cumsum(n)
        columns = [batch.column(0), pa.array(np.full(len(n), part), type=pa.int64()), pa.array(ends - n), batch.column(1)]
        yield pa.RecordBatch.from_arrays(columns, names=["__row", "__part", "__at", "__n"])
        before = int(ends[-1]) if len(n) else before


def _cut(length: int, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")
    new = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            # The last two columns are the ids and the document's place.
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                take, made = [], []
                for i in range(part.num_rows):
                    ids = np.frombuffer(part.column(part.num_columns - 2)[i].as_buffer(), dtype=kind)
                    place = part.column(part.num_columns - 1)[i].as_py()
                    start = 0
                    while start < len(ids):
                        sequence, offset = divmod(place + start, length)
                        n = min(length - offset, len(ids) - start)
                        crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                        take.append(i)
                        made.append((start, n, crc, len(ids), sequence, offset))
                        start += n
                rows = part.take(pa.array(take, type=pa.int64()))
                columns = [pa.array(v, type=pa.int64()) for v in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-2], *columns], names=[*part.schema.names[:-2], *new])

    return run


def pack(
    docs: DataFrame, rank_file: str, pattern: str, end_id: int = 1, length: int = 2048, vocabulary: int = 50257,
    json_file: str | None = None,
) -> DataFrame:
    """Pieces of ``docs``: its columns but for ``text``, and start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: empty) and then ``end_id``; ids are cut freely into pieces of
    sequences of ``length``. Every sequence but the last is full, so only the last is padded. Documents lie in
    the order of (Hilbert key, doc_id, row). Repeated rows are documents of their own; null ids come
    first among equal keys. No rows give no rows. Columns pass through whatever their names, save those added.

    ``rank_file`` must be readable under the same path on every worker; it is part of an installed package. So must
    ``json_file``, the same vocabulary for tokenizers (default: beside it, ending in .json), which takes the texts that tiktoken fails on.
    """
    from pyspark.sql import types as T

    spark = docs.sparkSession
    folder = shared_folder(spark)
    wide = max(vocabulary, end_id + 1) > 1 << 16
    added = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    columns = [c for c in docs.columns if c not in added]
    base = docs.select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`") for c in columns])
    schema = T.StructType([f for f in base.schema if f.name != "text"])
    others = [f for f in schema if f.name != "__row"]
    for name, kind in (("__ids", "binary"), ("__n", "long"), ("__key", "long")):
        schema = schema.add(name, kind)
    json_file = json_file or f"{rank_file.removesuffix('.tiktoken')}.json"
    run = _tokenize(rank_file, pattern, json_file, end_id, wide, max(vocabulary, end_id + 1), base.columns.index("text"))
    made = stored(base.mapInArrow(run, schema), folder, "ids")
    # Sorted by key, not only by range, before the ids are numbered.
    order = made.select("__row", "__n", "__key", "doc_id").repartitionByRange(width(spark), "__key", "doc_id", "__row")
    order = order.sortWithinPartitions("__key", "doc_id", "__row").select("__row", "__n")
    placed = stored(order.mapInArrow(_place, "__row long, __part long, __at long, __n long"), folder, "places")
    # One row per range.
    totals = placed.groupBy("__part").agg(F.sum("__n").alias("all"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    placed = placed.join(F.broadcast(totals), "__part").select("__row", (F.col("__at") + F.col("before")).alias("__place"))
    out = T.StructType([*others])
    for name in added:
        out = out.add(name, "long")
    joined = made.join(placed, "__row").select(*[F.col(f"`{f.name}`") for f in others], "__ids", "__place")
    return joined.mapInArrow(_cut(length, wide), out)
