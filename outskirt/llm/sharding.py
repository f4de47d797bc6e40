"""Sharding by extendible hashing.

A document's hash is 60 bits of the MD5 of its id. A shard is a bucket of a directory indexed by leading bits: all
documents whose hash begins with the bucket's bits. Only a bucket above the byte limit is split, on its next bit. Rounds of
``STEP`` bits do that: an aggregate sums the bytes of each cell (the next STEP bits) of the oversized buckets, the sums of
shorter prefixes follow from those, and every cell goes to the shortest prefix that fits. Rows whose cell still does not
fit go on to the next round. The directory never leaves Spark, and only tables of at most ``BROADCAST_ROWS`` rows are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.llm.shared import shared_folder, stored

BITS, STEP = 60, 10
SHARD_BYTES = 1 << 20
BROADCAST_ROWS = 20_000


def _beside(small: DataFrame, rows: int) -> DataFrame:
    """``small``, of up to so many ``rows``, for a broadcast if they are few, else for a merge join.

    Spark's own check goes by the size of files, and those of cells are far smaller than their rows."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge")


def _hashed(rows: DataFrame, folder: str) -> DataFrame:
    """Rows (row, doc_id, doc_bytes) with ``hash``; rows of an id that repeats (or is null) are told apart by their place."""
    repeats = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    repeats = stored(repeats.select(F.col("doc_id").alias("again"), F.lit(True).alias("many")), folder, "repeats")
    rows = rows.join(_beside(repeats, repeats.count()), rows["doc_id"].eqNullSafe(repeats["again"]), "left")
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    name = F.when(F.col("many"), F.concat_ws("#", own, F.col("row").cast("string"))).otherwise(own)
    return rows.select("row", "doc_id", "doc_bytes", F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long").alias("hash"))


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Per row doc_id, doc_bytes, shard (the bucket's bits, '' if one shard holds all), depth, shard_bytes, shard_docs.

    Every shard has at most ``limit`` bytes of text (UTF-8), unless it holds a single document that is larger itself.
    A null text has 0 bytes. Repeated and null ids are spread by row, so they can be split like others; rows are known
    by place: give a table as read, or one that has been stored. No rows give no rows."""
    folder = shared_folder(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", size.alias("doc_bytes")), folder, "rows")
    left = stored(_hashed(rows, folder), folder, "hashed")
    out, depth = None, 0
    while True:
        deep = min(depth + STEP, BITS)
        cells = left.groupBy(F.shiftright("hash", BITS - deep).alias("cell")).agg(F.sum("doc_bytes").alias("b"), F.count("*").alias("n"))
        cells = stored(cells, folder, f"cells{deep}")
        n = cells.count()
        # The sums of all prefixes from the present depth on; the first round also tries depth 0.
        depths = F.explode(F.sequence(F.lit(depth if depth == 0 else depth + 1), F.lit(deep))).alias("depth")
        prefixes = cells.select("cell", "b", "n", depths)
        prefixes = prefixes.withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
        sums = prefixes.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS)
        best = prefixes.select("cell", "depth", "prefix").join(_beside(sums.where(fits), n * (deep - depth + 1)), ["depth", "prefix"])
        best = best.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
        best = stored(best.select("cell", "s.*"), folder, f"buckets{deep}")
        placed = left.withColumn("cell", F.shiftright("hash", BITS - deep)).join(_beside(best, n), "cell", "left")
        placed = stored(placed.drop("cell"), folder, f"placed{deep}")
        done = placed.where("depth is not null")
        out = done if out is None else out.unionByName(done)
        left = placed.where("depth is null").select("row", "doc_id", "doc_bytes", "hash")
        if deep == BITS or left.isEmpty():
            break
        depth = deep
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select("row", "doc_id", "doc_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")


def write(docs: DataFrame, folder: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` below ``folder``, a sub-folder ``shard=...`` for each shard; returns the assignment."""
    own = shared_folder(docs.sparkSession)
    docs = stored(docs, own, "docs")
    placed = assign(docs, limit)
    keyed = docs.withColumn("__row", F.monotonically_increasing_id())
    joined = keyed.join(placed.select(F.col("row").alias("__row"), F.concat(F.lit("b"), "shard").alias("shard")), "__row")
    joined.drop("__row").repartition("shard").write.partitionBy("shard").parquet(folder)
    return placed
