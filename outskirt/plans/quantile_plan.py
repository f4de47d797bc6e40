"""Partition plan by exact quantiles of the coordinates, for many dimensions: no grid cells and no histogram of them.

Level by level, every box of more than ``2k + 1`` points is cut in one dimension at the values of rank ``ceil(j n / buckets)``,
all boxes of a level at once. The values are selected by KLL sketches and exact counts in turn: a sketch per open bracket names a
few values around each rank, one pass counts the points between them, and a rank that is not met goes on in the narrower bracket.
So what is shuffled is a sketch per task and bracket and some counts, and the result does not depend on the sketches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.operators.histogram import dimension_order, index_names, placed, slab_frequency
from outskirt.operators.joins import lookup_join
from outskirt.params import ScoreParams
from outskirt.plans.grid_plan import CUT_DIMS
from outskirt.session import SMALL_ROWS, keep, keep_small

# Items that a sketch keeps at its widest level, and into how many parts it divides a bracket.
SKETCH, PARTS = 2048, 256
# Hexadecimal digits of a child's number in a path.
DIGITS = 4
MOST_CHILDREN = 16**DIGITS


@dataclass(frozen=True)
class QuantilePlan:
    """``steps``: per level the dimension and the stored cuts (``node, cuts``). ``boxes``: ``path, n, ranges``, where ``ranges``
    has a ``(dim, lo, hi)`` per cut: the box holds ``lo < x <= hi``, null standing for infinity. The boxes tile the space."""

    steps: tuple[tuple[int, DataFrame], ...]
    boxes: DataFrame
    buckets: int

    def nodes(self, points: DataFrame) -> DataFrame:
        """``id, node``: the path of every point's box, whether or not the plan was made of it."""
        return _descended(points, self.steps, self.buckets).select("id", "node")


def quantile_plan(points: DataFrame, p: ScoreParams, levels: int = CUT_DIMS) -> QuantilePlan:
    """Cut ``points`` (``id, c``) in the ``levels`` dimensions that come first in order of uniformity, each into at most
    ``p.buckets`` parts of equal count; equal values stay together, so a part may be larger and others missing.

    ``points`` are read some times a level, so the caller keeps them where they are costly. Without points the plan is one box."""
    if p.buckets > MOST_CHILDREN:
        raise ValueError(f"at most {MOST_CHILDREN} buckets per dimension")
    ones = placed(points, p, every=True).selectExpr(*index_names(p), "1L as n")
    order = dimension_order(slab_frequency(ones, p), p)[:levels]
    steps: tuple = ()
    boxes = points.selectExpr("'' as path", "1 as one").groupBy().agg(F.count("one").alias("n"))
    boxes = keep_small(boxes.selectExpr("'' as path", "n", f"cast(array() as {_RANGES}) as ranges"), 1)
    for level, dim in enumerate(order):
        parents, children = p.buckets**level, p.buckets ** (level + 1)
        # the last rank is the largest value, at which nothing is cut
        ranks = f"array_distinct(transform(sequence(1L, {p.buckets}L), j -> (j * n + {p.buckets - 1}) div {p.buckets}))"
        wanted = boxes.where(f"n > {2 * p.k + 1}").selectExpr("path as node", "n", f"{ranks} as ranks")
        # without a negative zero, which equals zero but is another value to a sketch
        values = _descended(points, steps, p.buckets).selectExpr("node", f"c[{dim}] + 0.0D as v")
        found = selected(values, wanted, parents, p.buckets)
        cuts = found.groupBy("node").agg(F.expr("array_sort(collect_set(cut)) as c"))
        cuts = keep_small(cuts.selectExpr("node", "slice(c, 1, size(c) - 1) as cuts"), children)
        steps += ((dim, cuts),)
        counts = _descended(points, steps, p.buckets).groupBy("node").agg(F.count("*").alias("m"))
        split = boxes.join(cuts.withColumnRenamed("node", "path"), "path", "left")
        # a box that was not cut is its own child
        split = split.selectExpr("*", "explode(if(cuts is null, array(-1), sequence(0, size(cuts)))) as i")
        own = f"named_struct('dim', {dim}, 'lo', get(cuts, i - 1), 'hi', get(cuts, i))"
        split = split.selectExpr(
            f"if(i < 0, path, concat(path, {_digits('i')})) as node",
            "n",
            f"if(i < 0, ranges, concat(ranges, array({own}))) as ranges",
        )
        boxes = split.join(counts, "node", "left").selectExpr("node as path", "coalesce(m, n) as n", "ranges")
        boxes = keep_small(boxes, children * len(steps))
    return QuantilePlan(steps, boxes, p.buckets)


_RANGES = "array<struct<dim:int,lo:double,hi:double>>"


def _digits(number: str) -> str:
    return f"lpad(lower(hex({number})), {DIGITS}, '0')"


def below(array: str, value: str, most: int) -> str:
    """How many items of an ascending ``array`` of at most ``most`` are below ``value``, by halving; null, as the first one, is below all."""
    steps = ", ".join(str(1 << i) for i in reversed(range(max(most, 1).bit_length())))
    return (
        f"aggregate(array({steps}), 0, (at, s) ->"
        f" if(at + s <= size({array}) and coalesce(get({array}, at + s - 1) < {value}, true), at + s, at))"
    )


def _descended(points: DataFrame, steps: tuple, buckets: int) -> DataFrame:
    """``points`` with ``node``: one lookup per level, nothing is multiplied."""
    found = points.selectExpr("id", "c", "'' as node")
    for level, (dim, cuts) in enumerate(steps):
        found = lookup_join(found, cuts, "node", (64 + 8 * buckets) * buckets**level, how="left")
        child = f"concat(node, {_digits(below('cuts', f'c[{dim}]', buckets))})"
        found = found.selectExpr("id", "c", f"if(cuts is null, node, {child}) as node")
    return found


def selected(values: DataFrame, wanted: DataFrame, nodes: int, ranks: int) -> DataFrame:
    """``node, cut``: the values with the given ranks.

    ``values`` is ``node, v``, ``wanted`` is ``node, n, ranks`` with the number of values and the ranks from 1; there are at most
    ``nodes`` nodes with at most ``ranks`` ranks each. Every round takes at least one value out of each open bracket, and
    as a sketch divides a bracket into ``PARTS`` parts, rounds are some log(n) / log(PARTS)."""
    small, size = nodes * ranks * 4, nodes * (64 + 64 * ranks)
    # a bracket has the values lo < v < hi; below of the node's values are lo or smaller, n are in it
    brackets = wanted.selectExpr(
        "node", "0L as part", "cast(null as double) as lo", "cast(null as double) as hi", "0L as below", "n", "ranks"
    )
    found = None
    fractions = ", ".join(f"{(i + 0.5) / PARTS!r}D" for i in range(PARTS))
    while True:
        sketches = (
            _within(values, _listed(brackets, small), size, ranks)
            .groupBy("node", "part")
            .agg(F.expr(f"kll_sketch_agg_double(v, {SKETCH})").alias("sketch"))
            .selectExpr("node", "part", f"kll_sketch_get_quantile_double(sketch, array({fractions})) as q")
        )
        # of the sketch's values the ones next to each rank
        near = f"slice(q, cast(greatest(1, floor((r - below - 0.5D) / n * {PARTS})) as int), 3)"
        pivots = f"array_sort(array_distinct(flatten(transform(ranks, r -> {near}))))"
        cut = brackets.join(sketches, ["node", "part"]).selectExpr(*brackets.columns, f"{pivots} as pivots")
        cut = keep_small(cut, small)
        # even slots lie between pivots, odd ones are pivots
        inside = _within(values, _listed(cut, small, "pivots"), size, ranks, "pivots")
        inside = inside.selectExpr("node", "part", "v", "pivots", f"{below('pivots', 'v', PARTS)} as at")
        counts = inside.selectExpr("node", "part", "2 * at + cast(coalesce(get(pivots, at) = v, false) as int) as slot")
        counts = counts.groupBy("node", "part", "slot").agg(F.count("*").alias("m"))
        # a bracket's slots in one row: each rank finds its own by halving, so that no row per rank and slot is made
        counts = counts.selectExpr("node", "part", "slot", "m", "sum(m) over (partition by node, part order by slot) as upto")
        counts = counts.groupBy("node", "part").agg(F.expr("array_sort(collect_list(struct(slot, m, upto))) as s"))
        counts = counts.selectExpr("node", "part", "s.slot as slots", "s.m as ms", "s.upto as uptos")
        each = cut.join(counts, ["node", "part"])
        at = below("uptos", "r - below", 2 * PARTS + 1)
        each = each.selectExpr("*", f"transform(ranks, r -> struct(r, {at} as at)) as rs")
        slot, edge = "slots[x.at]", "get(pivots, cast(slots[x.at] div 2 as int){})"
        fields = f"x.r as r, {slot} as slot, ms[x.at] as m, uptos[x.at] as upto, {edge.format('')} as pivot, {edge.format(' - 1')} as before"
        each = each.selectExpr("node", "part", "lo", "hi", "below", f"inline(transform(rs, x -> struct({fields})))")
        each = keep_small(each, small)
        met = each.where("slot % 2 = 1").selectExpr("node", "pivot as cut")
        found = met if found is None else found.unionByName(met)
        narrower = each.where("slot % 2 = 0")
        if narrower.isEmpty():
            return found
        # a bracket is told by the smallest of its ranks
        brackets = narrower.groupBy("node", "part", "slot").agg(
            F.min("r").alias("first"),
            F.expr("first(coalesce(before, lo)) as lo"),
            F.expr("first(coalesce(pivot, hi)) as hi"),
            F.expr("first(below + upto - m) as below"),
            F.expr("first(m) as n"),
            F.collect_set("r").alias("ranks"),
        )
        brackets = brackets.selectExpr("node", "first as part", "lo", "hi", "below", "n", "ranks")


def _listed(brackets: DataFrame, rows: int, *more: str) -> DataFrame:
    """``node`` and arrays of its brackets' columns, ascending; a table of many rows is kept for the joins."""
    fields = ("lo", "hi", "part", *more)
    listed = brackets.groupBy("node").agg(F.expr(f"sort_array(collect_list(struct({', '.join(fields)}))) as b"))
    listed = listed.selectExpr("node", *(f"b.{c} as {c}s" for c in fields))
    return listed if rows <= SMALL_ROWS else keep(listed)


def _within(values: DataFrame, listed: DataFrame, size: int, ranks: int, *more: str) -> DataFrame:
    """``values`` that are in a bracket of their node (in one at most), with its ``part``."""
    met = lookup_join(values, listed, "node", size).selectExpr("*", f"{below('los', 'v', ranks)} - 1 as i")
    met = met.where("i >= 0 and (get(his, i) is null or v < get(his, i))")
    return met.selectExpr("node", "v", *(f"get({c}s, i) as {c}" for c in ("part", *more)))
