"""Points at one location.

Equal coordinates have equal distances to everything, and ties go to smaller ids. So
only the ``k + 1`` smallest ids of a location can be anyone's neighbours, and all ids
from the ``k + 2``-nd on have the same neighbours. A location that holds a third of the
table is thereby searched with ``k + 2`` rows; the other rows copy the last one's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from outskirt.functions.geometry import UNROLL_DIMS, items
from outskirt.operators.joins import lookup_join


# Spark limits a window's groups before the shuffle up to this row number (its default).
GROUP_LIMIT = 1000
PARTS = 4096


def representatives(points: DataFrame, k: int, dims: int) -> DataFrame:
    """``id, c, place``: the ``k + 2`` smallest ids per location, numbered from 1.

    Spark applies the limit within each input partition before the shuffle.
    """
    at = ", ".join(items("c", dims)) if dims <= UNROLL_DIMS else "c"
    place = f"row_number() over (partition by {at} order by id) as place"
    if k + 2 > GROUP_LIMIT:
        # too many for that limit: a location is thinned in parts first
        part = f"row_number() over (partition by {at}, pmod(xxhash64(id), {PARTS}) order by id) as place"
        points = points.selectExpr("id", "c", part).where(f"place <= {k + 2}")
    return points.selectExpr("id", "c", place).where(f"place <= {k + 2}")


def spread_to_copies(points: DataFrame, results: DataFrame, k: int, crowded: int) -> DataFrame:
    """Results of the representatives (``id, c, place, ...``) plus a copy for every other point.

    ``crowded`` is the number of locations with at least ``k + 2`` points.
    """
    out = results.drop("place")
    if not crowded:
        return out
    last = results.where(f"place = {k + 2}").drop("place")
    payload = [c for c in last.columns if c not in ("id", "c")]
    source = last.selectExpr("xxhash64(c) as spot", "c as at", "id as last_id", *payload)
    # the location's hash is the key; two locations under one hash are told apart below
    wanted = points.selectExpr("id", "c", "xxhash64(c) as spot")
    matched = lookup_join(wanted, source, "spot", crowded * (256 + 64 * k)).where(
        "c = at and id > last_id"
    )
    return out.unionByName(matched.select("id", "c", *payload))
