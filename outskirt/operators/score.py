"""Neighbour forces and the scores made of them.

* force of neighbour s on point o: ``(o - s) * d(o, s)^2``
* lcf: length of the sum of a point's forces
* nof: mean lcf of the k neighbours, 0 where the point's own lcf is 0
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.functions.geometry import force, norm
from outskirt.functions.neighbors import edges
from outskirt.functions.numeric import finite_or_zero, lit, round_to, scaled, unit, zero
from outskirt.operators.joins import lookup_join
from outskirt.params import ScoreParams

ZERO_LCF = 1e-9


def force_vectors(knn: DataFrame, p: ScoreParams) -> DataFrame:
    """``id, nid, rank, d, f0, f1, ...`` rounded to the force scale."""
    parts = [
        f"{round_to(force(f'c[{i}]', f's[{i}]', 'd'), p.force_scale, p.wide)} as f{i}" for i in range(p.dims)
    ]
    return edges(knn, p.dims).selectExpr("id", "nid", "rank", "d", *parts)


def net_force(knn: DataFrame, p: ScoreParams) -> DataFrame:
    """Add ``kdist`` and ``lcf``; both come from the row's own list, so nothing is shuffled."""
    exact = p.force_scale is not None
    part = force("x", f"nc[j * {p.dims} + i]", "nd[j]")
    part = scaled(part, p.force_scale, p.wide) if exact else part
    total = f"aggregate(sequence(0, size(nid) - 1), {zero(p.wide) if exact else '0.0D'}, (s, j) -> s + {part})"
    total = f"cast({total} as double) / {unit(p.force_scale)}" if exact else total
    sums = f"if(size(nid) = 0, cast(array() as array<double>), transform(c, (x, i) -> {total}))"
    square = "aggregate(net, 0.0D, (s, v) -> s + v * v)"
    return (
        knn.selectExpr("*", f"{sums} as net")
        .selectExpr(
            "*", "try_element_at(nd, -1) as kdist", f"{round_to(f'sqrt({square})', p.lcf_scale, p.wide)} as lcf"
        )
        .drop("net")
    )


def net_force_of(vectors: DataFrame, p: ScoreParams) -> DataFrame:
    """``id, kdist, lcf`` from a table of force vectors (partial sums merge before the shuffle)."""
    if p.force_scale is None:
        sums = [f"sum(f{i})" for i in range(p.dims)]
    else:
        sums = [f"(cast(sum({scaled(f'f{i}', p.force_scale, p.wide)}) as double) / {unit(p.force_scale)})" for i in range(p.dims)]
    return vectors.groupBy("id").agg(
        F.max("d").alias("kdist"), F.expr(norm(sums, p.lcf_scale, p.wide)).alias("lcf")
    )


def _mean_of(m: str, p: ScoreParams) -> str:
    """Aggregate: mean neighbour lcf with k as the divisor."""
    if p.lcf_scale is None:
        total = f"sum({m})"
    else:
        total = f"cast(sum({scaled(m, p.lcf_scale, p.wide)}) as double) / {unit(p.lcf_scale)}"
    return round_to(f"{total} / {lit(p.k)}", p.nof_scale, p.wide)


def _nof(p: ScoreParams) -> str:
    return f"if(lcf <= {lit(ZERO_LCF)}, 0.0D, {finite_or_zero('mean')}) as nof"


def mean_neighbor_force(forces: DataFrame, p: ScoreParams, rows: int) -> DataFrame:
    """Add ``nof`` to ``id, nid, kdist, lcf, ...`` and drop ``nid``.

    Only ids and one number per edge travel. A hub that is everyone's neighbour is a hot
    key of the lookup, which ``lookup_join`` splits.
    """
    lcf = forces.selectExpr("id as nid", "lcf as m")
    pairs = forces.selectExpr("id", "explode(nid) as nid")
    means = (
        lookup_join(pairs, lcf, "nid", 24 * rows).groupBy("id").agg(F.expr(_mean_of("m", p)).alias("mean"))
    )
    kept = [c for c in forces.columns if c != "nid"]
    return forces.drop("nid").join(means, "id", "left").selectExpr(*kept, _nof(p))


def scored_neighbors(forces: DataFrame, p: ScoreParams, rows: int) -> DataFrame:
    """``id, c, kdist, lcf, nof, neighbors``; the list has each neighbour's distance, force, kdist and lcf.

    Input is ``id, c, nid, nd, nc, kdist, lcf``; one pass over the edges gives score and list.
    """
    known = forces.selectExpr("id as nid", "kdist as nk", "lcf as m")
    vector = ", ".join(round_to(force(f"c[{i}]", f"s[{i}]", "d"), p.force_scale, p.wide) for i in range(p.dims))
    pairs = edges(forces, p.dims).selectExpr("id", "nid", "rank", "d", f"array({vector}) as f")
    entry = "named_struct('rank', rank, 'nid', nid, 'd', d, 'f', f, 'kdist', nk, 'lcf', m)"
    lists = (
        lookup_join(pairs, known, "nid", 32 * rows)
        .groupBy("id")
        .agg(F.expr(_mean_of("m", p)).alias("mean"), F.expr(f"array_sort(collect_list({entry}))").alias("neighbors"))
    )
    return forces.join(lists, "id", "left").selectExpr("id", "c", "kdist", "lcf", _nof(p), "neighbors")
