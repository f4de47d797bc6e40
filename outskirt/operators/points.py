"""Point tables: checks, bounds, normalisation, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from outskirt.functions.cells import in_domain
from outskirt.functions.numeric import lit, round_to
from outskirt.params import ScoreParams


def coordinate_columns(df: DataFrame, dims: int | None = None) -> list[str]:
    """Coordinate columns of a positional table: all after the first, or the next ``dims``."""
    cols = df.columns[1:]
    if dims is not None:
        if len(cols) < dims:
            raise ValueError(f"{dims} coordinates wanted, table has {len(cols)}")
        cols = cols[:dims]
    return cols


def bounds(df: DataFrame, coords: Sequence[str] | None = None) -> DataFrame:
    """One row ``min_c, max_c, ...`` in column order, from one pass."""
    parts = []
    for c in coords or coordinate_columns(df):
        parts += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*parts)


def normalize(
    df: DataFrame,
    coords: Sequence[str] | None = None,
    low: float = 0.0,
    high: float = 1.0,
    scale: int | None = 4,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Min-max scale each coordinate to ``[low, high]``; a constant column becomes ``low``.

    The limits are one row; they go into the plan as literals.
    """
    coords = list(coords or coordinate_columns(df))
    row = (limits or bounds(df, coords)).first()

    def scaled(c: str) -> str:
        lo, hi = row[f"min_{c}"], row[f"max_{c}"]
        if lo is None or lo == hi:
            return f"if(`{c}` is null, null, {lit(low)})"
        share = f"(`{c}` - {lit(lo)}) / {lit(float(hi) - float(lo))}"
        if (low, high) != (0.0, 1.0):
            share = f"{share} * {lit(high - low)}"
        value = round_to(share, scale)
        return value if low == 0.0 else f"{value} + {lit(low)}"

    return df.selectExpr(
        *[f"{scaled(c)} as `{c}`" if c in coords else f"`{c}`" for c in df.columns]
    )


def sample_by_id(df: DataFrame, denominator: int, scale: int | None = 2) -> DataFrame:
    """Rows whose id is a multiple of ``denominator``, coordinates rounded."""
    ident = df.columns[0]
    return df.where(f"`{ident}` % {denominator} = 0").selectExpr(
        f"`{ident}`", *[f"{round_to(f'cast(`{c}` as double)', scale)} as `{c}`" for c in df.columns[1:]]
    )


#: Rows that share the last part of a sample's threshold and are put in order; bits of a hash that are counted at once.
_ORDERED_ROWS, _HASH_BITS, _STEP_BITS = 20_000, 60, 12


def sample_random(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """``rows`` random rows without replacement: those with the smallest hash of id and ``seed`` (ties: smallest id).

    The hash that ends the sample is found by counting prefixes, ``2 ** _STEP_BITS`` at a time; only rows with the last
    prefix are put in order. All others are taken where they lie."""
    ident = df.columns[0]
    digest = F.md5(F.concat_ws(":", F.col(f"`{ident}`").cast("string"), F.lit(str(seed))).cast("binary"))
    hashed = df.withColumn("__hash", F.conv(F.substring(digest, 1, _HASH_BITS // 4), 16, 10).cast("long"))
    low, bits, left = 0, 0, rows  # hashes below `low` are in, and `left` of those whose first `bits` are those of `low`
    while True:
        bits += _STEP_BITS
        width = 1 << (_HASH_BITS - bits)
        inside = hashed.where(F.col("__hash").between(low, low + (width << _STEP_BITS) - 1))
        counts = inside.groupBy(F.expr(f"(__hash - {low}) div {width}").alias("at")).agg(F.expr("count(1)").alias("n"))
        for at, n in sorted(counts.collect()):
            if n >= left:
                break
            left -= n
        else:  # fewer rows than asked for
            return df
        low += at * width
        if n <= _ORDERED_ROWS or bits >= _HASH_BITS:
            break
    last = hashed.where(F.col("__hash").between(low, low + width - 1)).orderBy("__hash", ident).limit(left)
    return hashed.where(F.col("__hash") < low).unionByName(last).drop("__hash")


def as_points(
    df: DataFrame,
    p: ScoreParams,
    rejected: Observation | None = None,
    bounded: bool = True,
) -> DataFrame:
    """Positional table to ``id, c`` with ``c`` the coordinate array.

    Rows with a null or NaN coordinate, or outside the domain, are dropped; pass an
    ``Observation`` to get their number as ``rejected``.
    """
    ident, coords = df.columns[0], coordinate_columns(df, p.dims)
    values = [round_to(f"cast(`{c}` as double)", p.point_scale) for c in coords]
    keep = " and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in coords)
    if bounded:
        keep = f"{keep} and {in_domain(values, p)}"
    if rejected is not None:
        df = df.observe(rejected, F.expr(f"count_if(not coalesce({keep}, false))").alias("rejected"))
    return df.where(keep).selectExpr(
        f"cast(`{ident}` as bigint) as id", f"array({', '.join(values)}) as c"
    )


def rejections(df: DataFrame, p: ScoreParams) -> DataFrame:
    """One row: ``rows, no_value, outside, kept`` of a positional table, as :func:`as_points` decides."""
    coords = coordinate_columns(df, p.dims)
    values = [round_to(f"cast(`{c}` as double)", p.point_scale) for c in coords]
    gap = " or ".join(f"`{c}` is null or isnan(`{c}`)" for c in coords)
    inside = in_domain(values, p)
    return df.selectExpr(
        "count(1) as rows",
        f"count_if({gap}) as no_value",
        f"count_if(not ({gap}) and not ({inside})) as outside",
        f"count_if(not ({gap}) and {inside}) as kept",
    )


def array_points(df: DataFrame, ident: str, array: str) -> DataFrame:
    """A table with a numeric array column to ``id, c``; rows with gaps are dropped."""
    c = f"transform({array}, v -> cast(v as double))"
    return df.selectExpr(f"cast({ident} as bigint) as id", f"{c} as c").where(
        "c is not null and not exists(c, v -> v is null or isnan(v))"
    )
