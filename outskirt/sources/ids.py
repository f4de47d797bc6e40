"""Row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.operators.joins import lookup_join
from outskirt.session import keep, keep_small

# monotonically_increasing_id() counts rows from 0 in each partition and puts the
# partition number above bit 33.
_PARTITION_BITS = 33


def with_sparse_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Put a unique, increasing id first."""
    return df.select(F.monotonically_increasing_id().alias(name), *df.columns)


def with_contiguous_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Put ids 1, 2, 3, ... in row order first.

    No global sort: rows are numbered inside their partition, and each partition gets the
    row count of those before it. The numbered rows are kept first, since a partition
    must not change between counting and numbering.
    """
    numbered = keep(df.select(F.monotonically_increasing_id().alias("_m"), *df.columns))
    numbered = numbered.selectExpr(f"shiftright(_m, {_PARTITION_BITS}) as _part", "*")
    counts = numbered.groupBy("_part").agg(F.expr("count(1)").alias("_n"))
    partitions = numbered.rdd.getNumPartitions()
    # one row per partition
    offsets = keep_small(counts, partitions).selectExpr(
        "_part", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _before"
    )
    within = f"(_m & {(1 << _PARTITION_BITS) - 1}L)"
    return lookup_join(numbered, offsets, "_part", 16 * partitions).selectExpr(
        f"_before + {within} + 1 as {name}", *[f"`{c}`" for c in df.columns]
    )
