"""SimHash near-duplicates by a segment-popcount embedding.

The 64 bits of a fingerprint are 32 segments of two; the bit counts of the segments (0, 1 or 2) are a point of a
grid, and the Manhattan distance of two points never exceeds the number of differing bits. Cut into eight blocks
of four segments, points at most 4 apart agree in at least four blocks. So the range join is an
equality join on the cells of 70 coarser grids, one for each choice of four blocks: every distinct
fingerprint is a row of one cell in each. What meets in a cell is compared by Manhattan distance, then bit by bit.
A wider bound is a parameter of :func:`links`; beyond 4 bits it finds what agrees in four blocks.

Cells of one fingerprint are dropped by an aggregate. Crowded cells (groups of near copies) are cut into
blocks, and each pair of blocks is one group of bounded size; such a group yields a star per component
in it instead of its links, so rows do not grow with the square of a group.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.llm.components import components
from outskirt.llm.shared import bucketed, rows_of, shared_folder, stored, width
from outskirt.llm.tokens import LOWER

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Blocks of a fingerprint that make a cell.
AGREE = 4
#: Fingerprints of a crowded cell that one block takes.
#: Rows of a file of cells: they compress so well that a split by bytes would hold most of them.
CELL_ROWS = 1 << 18
BLOCK = 1024
#: Groups up to this size are compared row against row, larger ones as a matrix.
SMALL = 24


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint over shingles of so many words, as an unsigned integer; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    data = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words)) - 1
    starts, ends = starts[: len(words) - k].tolist(), ends[k:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), 1 << 15):
        found = [digest(data[a:b], SEED) for a, b in zip(starts[i : i + (1 << 15)], ends[i : i + (1 << 15)], strict=True)]
        raw = np.array(found, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprint(batches):
    for batch in batches:
        made = [signed(simhash(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, type=pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (id, fp) of the whole texts."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(_fingerprint, f"id {kind}, fp long")


def grid_points(fps: np.ndarray) -> np.ndarray:
    """The segments' bit counts, two bits for each: 0 is 00, 1 is 01, 2 is 11. So written, Manhattan distance is the
    number of differing bits."""
    one, low = np.uint64(1), np.uint64(0x5555555555555555)
    return ((fps | (fps >> one)) & low) | ((fps & (fps >> one) & low) << one)


def near(x: np.ndarray, y: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Whether fingerprints are at most ``most`` bits apart: the lower bound first, exactly where it passes."""
    out = np.bitwise_count(grid_points(x) ^ grid_points(y)) <= most
    x, y = np.broadcast_arrays(x, y)
    out[out] = np.bitwise_count(x[out] ^ y[out]) <= most
    return out


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) in each of the coarser grids."""
    points = grid_points(fps)
    blocks = [(points >> np.uint64(8 * b)) & np.uint64(0xFF) for b in range(8)]
    cells = []
    for tag, chosen in enumerate(itertools.combinations(range(8), AGREE)):
        cell = np.full(len(fps), tag << 32, dtype=np.uint64)
        for place, b in enumerate(chosen):
            cell |= blocks[b] << np.uint64(8 * place)
        cells.append(cell)
    return np.concatenate(cells), np.tile(fps, len(cells))


def _spread(batches):
    schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 1024):
            cells, owners = cells_of(fps[i : i + 1024])
            yield rows_of({"cell": cells.view(np.int64), "fp": owners.view(np.int64)}, schema)


def _stars(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(smallest, other) of each component among ``fps``."""
    linked = near(fps[:, None], fps[None, :], most)
    left, out = np.ones(len(fps), dtype=bool), []
    for i in range(len(fps)):
        if not left[i]:
            continue
        front = np.zeros(len(fps), dtype=bool)
        front[i] = True
        group = front.copy()
        while front.any():
            front = linked[front].any(axis=0) & ~group
            group |= front
        left &= ~group
        members = np.sort(fps[group].view(np.int64))
        out += [(int(members[0]), int(x)) for x in members[1:]]
    return out


def _compare(most: int):
    """Rows sorted by (cell, i, j): links between fingerprints of one group. A group may reach over batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(keys: np.ndarray, fps: np.ndarray):
        new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        first = np.flatnonzero(new)
        a, b = [], []
        small = sizes[group] <= SMALL
        own, mine = fps[small], group[small]
        for d in range(1, int(min(SMALL, sizes.max()))):
            same = mine[d:] == mine[:-d]
            x, y = own[d:][same], own[:-d][same]
            close = near(x, y, most)
            a.append(x[close].view(np.int64))
            b.append(y[close].view(np.int64))
        for g in np.flatnonzero(sizes > SMALL):
            found = _stars(fps[first[g] : first[g] + sizes[g]], most)
            a.append(np.array([x for x, _ in found], dtype=np.int64))
            b.append(np.array([y for _, y in found], dtype=np.int64))
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            return rows_of({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema)
        return None

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
            if rest is not None:
                table = np.concatenate((rest, table))
            differs = (table[:, :3] != table[-1, :3]).any(axis=1)
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            done, rest = table[:cut], table[cut:]
            if len(done) and (out := links(done[:, :3], np.ascontiguousarray(done[:, 3]).view(np.uint64))):
                yield out
        if rest is not None and len(rest):
            if out := links(rest[:, :3], np.ascontiguousarray(rest[:, 3]).view(np.uint64)):
                yield out

    return run


def links(fps: DataFrame, folder: str, most: int = MOST_BITS) -> DataFrame:
    """``fps``: distinct fingerprints. Rows (a, b), a < b, that join fingerprints at most ``most`` bits apart whose bit counts
    agree in four blocks (up to 4 bits all do), or in a crowded group the smallest of a component with each other."""
    spark = fps.sparkSession
    # Dealt out by number: the table is narrow, what each row becomes is not.
    dealt = fps.select("fp").repartition(width(spark), "fp")
    met = stored(dealt.mapInArrow(_spread, "cell long, fp long"), folder, "cells", CELL_ROWS)
    # Stored, so that the join below stands on two plain tables and Spark can split a crowded cell.
    crowded = stored(met.groupBy("cell").agg(F.count("*").alias("n")).where("n >= 2"), folder, "crowded")
    # Never broadcast: how many cells are crowded grows with the corpus.
    met = met.hint("merge").join(crowded, "cell")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("cell", "own", other, "fp").select(
        "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    met = met.repartition(width(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")
    return met.mapInArrow(_compare(most), "a long, b long").distinct()


def groups(prints: DataFrame, folder: str) -> DataFrame:
    """``prints`` (id, fp), stored: rows (fp, component), the smallest id reachable over links of at most 4 bits."""
    fps = prints.groupBy("fp").agg(F.min("id").alias("least"))
    stars = components(links(fps, folder), folder)
    rooted = fps.join(stars.withColumnRenamed("a", "fp").withColumnRenamed("b", "root"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    # Both sides stored, so that Spark can split the join at a large component.
    rooted = stored(rooted, folder, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component")), folder, "least")
    return rooted.join(least, "root").select("fp", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    The fingerprint is SimHash over XXH64 (seed 42) of 4-word shingles, repeats included, of the text with A-Z
    lower-cased; fewer words are one shingle, null or wordless texts have fingerprint 0 and are linked like others.
    Fingerprints link at 4 or fewer differing bits. Repeated rows each get a row. A null id never is the
    smallest; a component of null ids only has a null component_id. No rows give no rows."""
    folder = shared_folder(docs.sparkSession)
    prints = stored(fingerprints(docs), folder, "prints")
    found = groups(prints, folder)
    return prints.join(found, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (null last), of such the first."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    base = bucketed(docs.select(F.monotonically_increasing_id().alias("__row"), *columns), folder, "texts", "__row")
    prints = stored(fingerprints(base, "__row"), folder, "prints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    ids = base.select("__row", order.alias("rank"))
    found = prints.join(groups(prints, folder), "fp").select(F.col("id").alias("__row"), "component")
    best = found.join(ids, "__row").groupBy("component").agg(F.min("rank").alias("rank"))
    kept = best.select(F.col("rank")["__row"].alias("__row"))
    return base.join(kept.hint("shuffle_hash"), "__row", "left_semi").select(*columns)
