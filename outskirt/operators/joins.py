"""Lookup join whose broadcast is bound to a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup side below this size is broadcast; callers pass a checked size.
BROADCAST_BYTES = 32 * 1024 * 1024


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    small_bytes: int,
    how: str = "inner",
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Join ``big`` to ``small`` on ``key``: ``small`` within the limit is broadcast, else both are shuffled.

    Adaptive execution splits the partitions of hot keys of the shuffle join. It needs both sides to be
    plain tables for that, so callers with possibly hot keys pass a kept ``small``.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    return big.join(F.broadcast(small) if small_bytes <= limit else small.hint("merge"), key, how)
