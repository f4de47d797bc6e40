"""Best-fit packing with matched large pieces: few sequences, each document whole unless it is longer than a sequence.

1. Tokenize and cut: a document's ids are one piece; a longer one gives full pieces, the first being the shorter. A
   task numbers its pieces of each size. This table is written once.
2. Count the pieces of each size. Pieces of one size are alike, so these counts (at most one row per size) are all that the plan needs:
   pieces above a third of a sequence are matched greedily, each, from the largest on, with the largest that fits beside it, so that
   a sequence holds two at most; smaller ones, from the largest on, go to the tightest gap that takes them, or
   else to a new sequence. A plan row places a range of the numbers of one size.
3. The numbers of a size run on over tasks: each task's first number is a running sum of counts. A piece finds the
   row of its size and number by a join on blocks of numbers, as many blocks as the size has rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outskirt.llm.packing import encoder
from outskirt.llm.shared import shared_folder, stored

ADDED = ("piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


class _Gaps:
    """Sequences by the room that is left, as ranges (first sequence, how many)."""

    def __init__(self):
        self.rooms: list[int] = []
        self.ranges: dict[int, list] = {}

    def add(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.ranges:
                insort(self.rooms, room)
            self.ranges.setdefault(room, []).append((first, n))

    def take(self, size: int):
        """(room, first, n) of the least room that takes ``size``, or None."""
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, n = self.ranges[room].pop()
        if not self.ranges[room]:
            del self.ranges[room], self.rooms[at]
        return room, first, n


def plan(counts: dict[int, int], length: int) -> list[tuple]:
    """Rows (size, first, n, per, sequence, offset): piece number first + i of ``size``, for i below n, is in
    sequence + i // per, at offset + i % per * size.

    The number of rows depends on ``length`` alone, not on the counts: matching uses up a size with each row or two and
    leaves two ranges of gaps for each; filling a range more than halves its room, and a size leaves two more ranges when it ends.
    """
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    rows, gaps, sequences = [], _Gaps(), 0

    def put(size: int, n: int, per: int, sequence: int, offset: int) -> None:
        rows.append((size, used[size], n, per, sequence, offset))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > length)
    while large:
        size = large[-1]
        alone = left[size] == 1
        at = bisect_left(large, min(length - size, size - alone) + 1) - 1
        partner = large[at] if at >= 0 else None
        if partner == size:
            n = left[size] // 2
            put(size, 2 * n, 2, sequences, 0)
        else:
            n = left[size] if partner is None else min(left[size], left[partner])
            put(size, n, 1, sequences, 0)
            if partner:
                put(partner, n, 1, sequences, size)
        gaps.add(length - size - (partner or 0), sequences, n)
        sequences += n
        large = [s for s in large if left[s]]
    for size in sorted((s for s in left if 3 * s <= length), reverse=True):
        while left[size]:
            found = gaps.take(size)
            if not found:
                n = -(-left[size] // (length // size))
                found = length, sequences, n
                sequences += n
            room, first, n = found
            per = room // size
            full = min(n, left[size] // per)
            if full:
                put(size, full * per, per, first, length - room)
                gaps.add(room - per * size, first, full)
            rest = left[size] if full < n else 0
            if rest:
                put(size, rest, rest, first + full, length - room)
                gaps.add(room - rest * size, first + full, 1)
                full += 1
            gaps.add(room, first + full, n - full)
    return rows


def _pieces(path: str, pattern: str, json_file: str, end_id: int, length: int, text_at: int):
    def run(batches):
        encode = encoder(path, pattern, json_file)
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, dtype=np.int64)
        for batch in batches:
            # Batches are cut so that the ids of few documents are held at once.
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                take, made = [], []
                for row, text in enumerate(some.column(text_at)):
                    ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                    cuts = [0, *range(len(ids) % length or length, len(ids), length), len(ids)]
                    for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
                        take.append(row)
                        own = ids[start:end].tobytes()
                        made.append((piece, start, end - start, own, zlib.crc32(own), part, seen[end - start]))
                        seen[end - start] += 1
                rows = some.take(pa.array(take, type=pa.int64()))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(v, type=k) for v, k in zip(zip(*made), kinds)]
                others = [c for i, c in enumerate(rows.columns) if i != text_at]
                names = [n for i, n in enumerate(rows.schema.names) if i != text_at]
                yield pa.RecordBatch.from_arrays([*others, *columns], names=[*names, *ADDED[:5], "__part", "__nth"])

    return run


def pack_whole(
    docs: DataFrame, rank_file: str, pattern: str, end_id: int = 0, length: int = 2048, json_file: str | None = None
) -> DataFrame:
    """Pieces of ``docs``: its columns but for ``text``, and piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text (null: empty) and then ``end_id``. Only documents longer than ``length``
    are cut. Pieces lie in a sequence without gaps from 0 on. Which of several pieces of one size is where, and the numbers of sequences,
    depend on how the table is split into tasks; the number of sequences does not. Who does not select ``ids`` does not shuffle them. Repeated rows are documents of their own; no
    rows give no rows; columns of the input pass through whatever their names, save those added.

    The driver sees one count per size, at most ``length``; the plan made of it is what tasks get (see ``plan``).
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED])
    others = [f for f in base.schema if f.name != "text"]
    schema = T.StructType([*others])
    for name, kind in zip((*ADDED[:5], "__part", "__nth"), ("integer", "long", "long", "binary", "long", "long", "long")):
        schema.add(name, kind)
    json_file = json_file or f"{rank_file.removesuffix('.tiktoken')}.json"
    run = _pieces(rank_file, pattern, json_file, end_id, length, base.columns.index("text"))
    made = stored(base.mapInArrow(run, schema), folder, "pieces")
    groups = stored(made.groupBy("__part", "length").agg(F.count("*").alias("__n")), folder, "groups")
    counts = dict(groups.groupBy("length").agg(F.sum("__n")).collect())
    rows = plan(counts, length)
    # Numbers of a size in as many blocks as it has rows, so that a piece meets two rows in the mean.
    per_size: dict[int, int] = {}
    for row in rows:
        per_size[row[0]] = per_size.get(row[0], 0) + 1
    block = {s: -(-counts[s] // n) for s, n in per_size.items()}
    places = [(b, *r) for r in rows for b in range(r[1] // block[r[0]], (r[1] + r[2] - 1) // block[r[0]] + 1)]
    names = "__block long, length long, __first long, __count long, __per long, __sequence long, __offset long"
    places = spark.createDataFrame(places, names)
    blocks = spark.createDataFrame(list(block.items()), "length long, __size long")
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select("__part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    firsts = firsts.join(F.broadcast(blocks), "length")
    numbered = made.join(firsts, ["__part", "length"]).withColumn("__number", F.col("__before") + F.col("__nth"))
    numbered = numbered.withColumn("__block", F.expr("__number div __size"))
    since = F.col("__number") - F.col("__first")
    found = numbered.join(F.broadcast(places), ["length", "__block"]).where((since >= 0) & (since < F.col("__count")))
    sequence = (F.col("__sequence") + F.expr("(__number - __first) div __per")).alias("sequence_id")
    offset = (F.col("__offset") + since % F.col("__per") * F.col("length")).alias("offset")
    return found.select(*[F.col(f"`{f.name}`") for f in others], *ADDED[:5], sequence, offset)
