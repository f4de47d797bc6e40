"""Equi-depth cuts of slab counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUN = "named_struct('lo', cast({lo} as int), 'hi', cast({hi} as int), 'n', cast({n} as bigint))"
_NO_RUNS = "cast(array() as array<struct<lo:int,hi:int,n:bigint>>)"


def equi_depth_cut(slabs: DataFrame, buckets: int, k: int, end: int) -> DataFrame:
    """Cut each parent's slabs into at most ``buckets`` runs of near-equal count.

    ``slabs`` is ``parent, slab, n`` (``n > 0``). The result is ``parent, bucket, lo,
    hi, n`` with half-open slab ranges that tile ``[0, end)``.

    A run closes once it holds its share ``max(k, total / buckets)``. A heavy slab that
    would lift a run of more than ``k`` points, at least half full, above twice the share
    opens the next run instead. The last run takes what is left; with fewer than ``k``
    points it joins the run before it.

    A parent has at most one row per slab, so the ordered list that is folded is as
    long as the grid is wide.
    """
    ordered = "array_sort(collect_list(struct(cast(slab as int) as slab, cast(n as bigint) as n)))"
    per_parent = slabs.groupBy("parent").agg(
        F.expr(ordered).alias("slabs"),
        F.expr(f"greatest({float(k)}D, sum(n) / {float(buckets)}D)").alias("share"),
    )
    start = f"named_struct('runs', {_NO_RUNS}, 'lo', 0, 'n', 0L)"
    # two small steps per slab: close the run before a heavy slab, then take the slab
    defer = (
        f"size(s.runs) < {buckets - 1} and s.n > {k} and s.n > 0.5D * share and s.n + e.n > 2.0D * share"
    )
    closed = _RUN.format(lo="s.lo", hi="e.slab", n="s.n")
    before = (
        f"if({defer}, named_struct('runs', concat(s.runs, array({closed})), 'lo', e.slab, 'n', e.n),"
        " named_struct('runs', s.runs, 'lo', s.lo, 'n', s.n + e.n))"
    )
    filled = _RUN.format(lo="t.lo", hi="e.slab + 1", n="t.n")
    after = (
        f"if(size(t.runs) < {buckets - 1} and t.n >= share,"
        f" named_struct('runs', concat(t.runs, array({filled})), 'lo', e.slab + 1, 'n', 0L), t)"
    )
    step = f"transform(array({before}), t -> {after})[0]"
    last = "element_at(s.runs, -1)"
    joined = _RUN.format(lo=f"{last}.lo", hi=end, n=f"{last}.n + s.n")
    own = _RUN.format(lo="s.lo", hi=end, n="s.n")
    finish = (
        f"if(size(s.runs) > 0 and s.n < {k},"
        f" concat(slice(s.runs, 1, size(s.runs) - 1), array({joined})), concat(s.runs, array({own})))"
    )
    return per_parent.selectExpr(
        "parent", f"posexplode(aggregate(slabs, {start}, (s, e) -> {step}, s -> {finish})) as (bucket, r)"
    ).selectExpr("parent", "bucket", "r.lo", "r.hi", "r.n")
