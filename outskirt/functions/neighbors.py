"""Neighbour lists: flat arrays inside the engine, structs and text outside.

The engine keeps per point ``nid`` (ids), ``nd`` (distances) and ``nc`` (all
coordinates, one after the other), nearest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

NEIGHBOR_TYPE = "array<struct<nid:bigint,rank:int,d:double,f:array<double>,kdist:double,lcf:double>>"


def edges(knn: DataFrame, dims: int, *keep: str) -> DataFrame:
    """One row per (point, neighbour): ``id, c, nid, rank, d, s`` with ``s`` the neighbour's coordinates."""
    return knn.selectExpr("id", "c", *keep, "nd", "nc", "posexplode(nid) as (pos, nid)").selectExpr(
        "id",
        "c",
        *keep,
        "nid",
        "pos + 1 as rank",
        "nd[pos] as d",
        f"slice(nc, pos * {dims} + 1, {dims}) as s",
    )


def to_text(neighbors: str) -> str:
    """A neighbour list as JSON text."""
    return f"to_json({neighbors})"


def from_text(text: str) -> str:
    return f"from_json({text}, '{NEIGHBOR_TYPE}')"
