"""Core cells of plan boxes as intervals of the Z-order curve.

The Z-number of a cell interleaves the bits of its indexes, so a box of cells is a set of intervals of the curve. A box is
followed down the curve's own halving: a stretch of the curve (a prefix of its bits) that lies in the box whole is
one interval, one that misses the box ends, any other is halved. No cell of the box's inside is visited, and the number of
intervals follows the box's surface; ``most`` bounds it: stretches left over then stand as they are, marked as not
``whole``, and are settled by the box's ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.functions.cells import cell_id
from outskirt.operators.histogram import index_names, placed
from outskirt.operators.joins import lookup_join
from outskirt.params import ScoreParams
from outskirt.plans.grid_plan import range_names
from outskirt.session import keep


def curve_bits(p: ScoreParams) -> int:
    """Bits of an index; all indexes together fit a BIGINT."""
    bits = max(1, (p.cells - 1).bit_length())
    if bits * p.dims > 62:
        raise ValueError("Z-numbers of this grid do not fit a BIGINT")
    return bits


def z_number(indexes: list[str], bits: int) -> str:
    """Bits of the indexes by turns, from the highest on, the first dimension first."""
    parts = [
        f"shiftleft(shiftright(cast({ix} as bigint), {b}) & 1, {b * len(indexes) + len(indexes) - 1 - d})"
        for d, ix in enumerate(indexes)
        for b in range(bits)
    ]
    return " | ".join(parts)


def z_indexes(z: str, dims: int, bits: int) -> list[str]:
    """The indexes of a Z-number (inverse of :func:`z_number`)."""
    return [
        "cast("
        + " | ".join(f"shiftleft(shiftright({z}, {b * dims + dims - 1 - d}) & 1, {b})" for b in range(bits))
        + " as int)"
        for d in range(dims)
    ]


def core_ranges(plan: DataFrame, p: ScoreParams, most: int = 4096) -> DataFrame:
    """``pid, z_lo, z_hi, whole``: every box's stretches of the curve, half-open, disjoint, in the box's ``lo, hi``.

    One round per bit of the curve, each a row per open stretch. A box with ``most`` stretches or more is not halved
    further; what is then open is given with ``whole`` false, and holds cells of other boxes too."""
    bits, names = curve_bits(p), range_names(p)
    size = 1 << bits
    corners = [f"0 as a{d}" for d in range(p.dims)] + [f"{size} as b{d}" for d in range(p.dims)]
    opened, closed = plan.selectExpr("pid", *names, "0L as z", *corners), None
    inside = " and ".join(f"a{d} >= lo{d} and b{d} <= hi{d}" for d in range(p.dims))
    meets = " and ".join(f"a{d} < hi{d} and b{d} > lo{d}" for d in range(p.dims))
    for step in range(bits * p.dims + 1):
        left = bits * p.dims - step
        opened = keep(opened.where(meets).withColumn("whole", F.expr(inside)))
        full = F.expr("count(1) over (partition by pid)") >= most
        marked = opened.withColumn("full", full & ~F.col("whole"))
        done = marked.where("whole or full").selectExpr(
            "pid", f"shiftleft(z, {left}) as z_lo", f"shiftleft(z + 1, {left}) as z_hi", "whole"
        )
        closed = done if closed is None else closed.unionByName(done)
        halved = marked.where("not whole and not full")
        if not left or halved.isEmpty():
            return closed
        d = step % p.dims
        middle = f"cast((a{d} + b{d}) div 2 as int)"
        sides = ["pid", *names, "shiftleft(z, 1) + h as z"]
        sides += [f"if(h = 1, {middle}, a{e}) as a{e}" if e == d else f"a{e}" for e in range(p.dims)]
        sides += [f"if(h = 0, {middle}, b{e}) as b{e}" if e == d else f"b{e}" for e in range(p.dims)]
        opened = halved.selectExpr("*", "explode(array(0, 1)) as h").selectExpr(*sides)
    return closed


def merged(ranges: DataFrame) -> DataFrame:
    """Stretches of a box that follow one another as one, whole ones only with whole ones."""
    before = "lag(z_hi) over (partition by pid, whole order by z_lo)"
    runs = ranges.selectExpr("*", f"if({before} = z_lo, 0, 1) as new")
    runs = runs.selectExpr("*", "sum(new) over (partition by pid, whole order by z_lo) as run")
    found = runs.groupBy("pid", "whole", "run").agg(F.min("z_lo").alias("z_lo"), F.max("z_hi").alias("z_hi"))
    return found.select("pid", "z_lo", "z_hi", "whole")


def range_cells(ranges: DataFrame, plan: DataFrame, p: ScoreParams) -> DataFrame:
    """``cell_id, pid``: the cells that the stretches stand for."""
    names = index_names(p)
    inside = " and ".join(f"{name} >= lo{d} and {name} < hi{d}" for d, name in enumerate(names))
    cells = ranges.join(plan.select("pid", *range_names(p)), "pid").selectExpr("*", "explode(sequence(z_lo, z_hi - 1)) as z")
    indexes = [f"{ix} as {name}" for ix, name in zip(z_indexes("z", p.dims, curve_bits(p)), names, strict=True)]
    cells = cells.selectExpr("pid", "whole", *range_names(p), *indexes).where(f"whole or ({inside})")
    return cells.selectExpr(f"{cell_id(names, p.cells)} as cell_id", "pid")


def range_points(points: DataFrame, plan: DataFrame, p: ScoreParams) -> DataFrame:
    """``id, pid``: points inside the domain with the box in whose stretches of the curve their cell lies.

    A stretch, as :func:`core_ranges` gives it, is one prefix of the curve's bits, so the join is one of equal (length,
    prefix): a point meets it once per length that occurs."""
    bits = curve_bits(p)
    ranges = keep(core_ranges(plan, p))
    stretches = ranges.selectExpr("pid", "whole", "z_hi - z_lo as width", "z_lo div (z_hi - z_lo) as bin")
    stretches = stretches.join(plan.select("pid", *range_names(p)), "pid")
    widths = sorted(r["width"] for r in stretches.select("width").distinct().collect())  # at most a row per bit
    names = index_names(p)
    cells = placed(points, p, "id").selectExpr("id", *names, f"{z_number(names, bits)} as z")
    if not widths:
        return cells.selectExpr("id", "cast(null as int) as pid").limit(0)
    lengths = ", ".join(f"{w}L" for w in widths)
    cells = cells.selectExpr("*", f"explode(array({lengths})) as width").selectExpr("*", "z div width as bin")
    keyed = F.struct("width", "bin").alias("key")
    stretches = stretches.select("pid", "whole", *range_names(p), keyed)
    inside = " and ".join(f"{name} >= lo{d} and {name} < hi{d}" for d, name in enumerate(names))
    found = lookup_join(cells.select("id", *names, keyed), stretches, "key", 64 * p.dims * ranges.count())
    return found.where(f"whole or ({inside})").select("id", "pid")
