"""Connected components of a graph in DataFrames: alternating large stars and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.llm.shared import dropped, stored


def _large_star(edges: DataFrame, folder: str, step: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored, so that Spark can split the join at the centre of a large star.
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), folder, f"large{step}")
    out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(edges: DataFrame, folder: str, step: int) -> DataFrame:
    down = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), folder, f"down{step}")
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), folder, f"small{step}")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``edges`` (a, b) of longs, a <> b: rows (a, b) where b is the smallest node reachable from a, b itself left out.

    A round keeps the number of edges or lowers it, and ends when a round leaves the set as it was."""
    spark = edges.sparkSession
    mark, last, step = None, None, 0
    while True:
        edges = stored(edges, folder, f"stars{step}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if last:
            dropped(spark, f"{folder}/stars{last - 1}")
        if tuple(now) == mark or now[0] == 0:
            return edges
        mark, last, step = tuple(now), step + 1, step + 1
        edges = _small_star(_large_star(edges, folder, step), folder, step)
