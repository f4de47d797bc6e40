"""Distance blocks: a box of points searched for its own neighbours, and a leaf against query points from other boxes.

Spark decides which blocks meet and ships them as Arrow arrays; the functions here
only turn one bounded box, or one pair of bounded blocks, into the k nearest of each query.

In many dimensions pivots rule out few pairs of spread-out points. There a matrix product bounds the distances of a block of pairs
from below (:class:`_Sieve`), and only pairs whose bound lies within the query's radius are measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from outskirt.params import ScoreParams
from outskirt.plans.kd_tree import Routes, leaves_of, many_dims

RESULT = "id bigint, nid array<bigint>, nd array<double>, nc array<double>"
POINT = f"{RESULT}, c array<double>, home string, settled boolean"
#: One row per leaf. ``n`` neighbours of each point are in ``nids``, ``nds``, ``ncs`` (empty in many dimensions). The points whose ball leaves the box are ``oids``, ...;
#: ``touch`` are the other boxes that a hull around those balls reaches into.
LEAF = (
    "box bigint, node bigint, home string, ids array<bigint>, cs array<double>, lo array<double>, hi array<double>, "
    "n array<int>, nids array<bigint>, nds array<double>, ncs array<double>, settled array<boolean>, "
    "oids array<bigint>, ocs array<double>, ogs array<double>, ors array<double>, touch array<bigint>"
)
ASK = "node bigint, qids array<bigint>, qcs array<double>, qrs array<double>, m bigint"
_FLUSH_ROWS = 20_000
# Points that a matrix product meets at once, pairs measured at once, and the share of a block's pairs from which all of them are measured.
_BLOCK_ROWS, _PAIRS, _DENSE = 4096, 1 << 10, 0.25
# A sieve of l1 cuts each coordinate at these quantiles; rows it takes them from.
_CUTS, _CUT_ROWS = (0.3, 0.7), 2048


def slack(radius, p: ScoreParams):
    """``radius`` widened so that a raw distance above it cannot round into a tie."""
    half = 0.0 if p.dist_scale is None else 0.5 * 10.0**-p.dist_scale
    return (radius + half) * (1.0 + 1e-9) + 1e-12


def _margin(g: np.ndarray, routes: Routes) -> float:
    """What rounding can do to differences of distances to pivots."""
    return 0.0 if routes.pivots is None else 1e-11 * float(np.abs(g).max(initial=0.0))


def _gap(g: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: ScoreParams, routes: Routes) -> np.ndarray:
    """Distance of each row of ``g`` to each box [lo, hi], or a lower bound of it."""
    total = np.zeros((len(g), len(lo)))
    for i in range(g.shape[1]):
        x = g[:, i, None]
        gap = np.maximum(np.maximum(lo[None, :, i] - x, x - hi[None, :, i]), 0.0)
        if routes.pivots is not None:
            np.maximum(total, gap, out=total)
        else:
            total += gap if p.metric == "l1" else gap * gap
    return np.sqrt(total) if routes.pivots is None and p.metric == "l2" else total


class _Best:
    """The k nearest so far of some points, by distance, then id."""

    def __init__(self, n: int, p: ScoreParams):
        self.d = np.full((n, p.k), np.inf)
        self.id = np.full((n, p.k), np.iinfo(np.int64).max)
        self.at = np.full((n, p.k), -1, dtype=np.int64)

    def merge(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        d, ids, at = (np.concatenate([old[rows], new], axis=1) for old, new in ((self.d, d), (self.id, ids), (self.at, at)))
        order = np.lexsort((ids, d), axis=1)[:, : self.d.shape[1]]
        self.d[rows], self.id[rows], self.at[rows] = (np.take_along_axis(x, order, axis=1) for x in (d, ids, at))

    def merge_pairs(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Like :meth:`merge`, with any number of entries per row."""
        own, k = np.unique(rows), self.d.shape[1]
        rows = np.concatenate([np.repeat(own, k), rows])
        d, ids, at = (np.concatenate([old[own].ravel(), new]) for old, new in ((self.d, d), (self.id, ids), (self.at, at)))
        order = np.lexsort((ids, d, rows))
        order = order[np.searchsorted(rows[order], own)[:, None] + np.arange(k)]
        self.d[own], self.id[own], self.at[own] = d[order], ids[order], at[order]


class _Sieve:
    """Bounds distances to the points ``cs`` from below, by one matrix product for a block of pairs.

    ``f(x) . f(y) >= a(x) + a(y) - h``, with ``h`` half the squared distance (l2) or half the distance (l1) of x and y. For l2, f(x) is x
    (seen from the middle) and both sides are equal. For l1, ``|x - y| = |x| + |y| - 2 min(|x|, |y|)`` on one side of a cut, without the last term
    across it. Beyond the outer cuts ``min(u, v) <= sqrt(u) sqrt(v)``, and within a piece between cuts, scaled to [0, 1],
    ``min(u, v) <= u v + sqrt(u (1 - u)) sqrt(v (1 - v))``: a ramp and its bridge. Both sides are equal unless x and y lie in one piece; the
    pairs left are looked at in single precision. ``f . f = 2 a`` in both, which bounds what single precision can do.
    """

    def __init__(self, cs: np.ndarray, queries: list[np.ndarray], p: ScoreParams):
        lo, hi = (f([f(x, axis=0) for x in (cs, *queries) if len(x)], axis=0) for f in (np.min, np.max))
        self.l1, self.p = p.metric == "l1", p
        # A power of two, so that scaling is exact; nothing overflows in single precision.
        self.unit = float(np.ldexp(1.0, min(int(np.frexp((hi - lo).max())[1]), 1023)))
        sample = cs[:: -(-len(cs) // _CUT_ROWS)]
        if self.l1:
            cuts = np.clip(np.quantile(sample, _CUTS, axis=0), lo, hi)
            self.centre = cuts[0]
            #: The cuts as seen from the first.
            self.cuts = [((x - cuts[0]) / self.unit).astype(np.float32) for x in cuts]
        else:
            self.centre = np.clip(np.median(sample, axis=0), lo, hi)
        self.width = p.dims * (2 * len(_CUTS) if self.l1 else 1)
        self.f, self.a = np.empty((len(cs), self.width + 2), dtype=np.float32), np.empty(len(cs))
        self.z = np.empty((len(cs) if self.l1 else 0, p.dims), dtype=np.float32)
        for start in range(0, len(cs), _BLOCK_ROWS):
            part = slice(start, start + _BLOCK_ROWS)
            z, self.a[part] = self._seen(cs[part])
            self._features(z, self.f[part])
            if self.l1:
                self.z[part] = z
        self.f[:, -2], self.f[:, -1] = 1.0, -self.a

    def _seen(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``x`` in single precision, scaled and seen from the middle, and a(x)."""
        z = ((x - self.centre) / self.unit).astype(np.float32)
        return z, 0.5 * (np.abs(z) if self.l1 else np.square(z, dtype=np.float64)).sum(axis=1, dtype=np.float64)

    def _features(self, z: np.ndarray, out: np.ndarray) -> None:
        """f of the points ``z`` into the first columns of ``out``."""
        d = z.shape[1]
        if not self.l1:
            out[:, :d] = z
            return
        np.sqrt(np.maximum(-z, 0), out=out[:, :d])
        np.sqrt(np.maximum(z - self.cuts[-1], 0), out=out[:, d : 2 * d])
        for j, (start, end) in enumerate(zip(self.cuts, self.cuts[1:]), 1):
            size = np.maximum(end - start, 0)
            u = np.clip(z - start, 0, size)
            scale = np.sqrt(size)
            scale = np.divide(1, scale, out=np.zeros_like(scale), where=scale > 0)
            np.multiply(u, scale, out=out[:, 2 * j * d : (2 * j + 1) * d])
            bridge = np.sqrt(size - u)  # not the root of a product, which may underflow
            bridge *= np.sqrt(u, out=u)
            np.multiply(bridge, scale, out=out[:, (2 * j + 1) * d : (2 * j + 2) * d])

    def asked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries ``x`` for :meth:`pairs`."""
        f, (z, a) = np.empty((len(x), self.width + 2), dtype=np.float32), self._seen(x)
        self._features(z, f)
        f[:, -1] = 1.0
        return f, a, z

    def pairs(self, f: np.ndarray, a: np.ndarray, z: np.ndarray, radius: np.ndarray, at) -> tuple[np.ndarray, np.ndarray]:
        """(query, point of ``at``) of all pairs that may be within the query's ``radius``, and more."""
        base, most = self.f[at], a.max() + self.a[at].max()
        radius = np.minimum(radius / self.unit, 1e9)
        half = np.minimum(0.5 * radius if self.l1 else 0.5 * radius * radius, 3.0 * most)  # no h is above 2 most
        f[:, -2] = half - a
        # Each product and sum is off by 2^-24 of itself at most, features and coordinates by a few times that.
        off = (self.width + 32) * 2.0**-24 * (2.0 * most + half.max()) * 1.01 + 1e-30
        product = f @ base.T
        i, j = np.divmod(np.flatnonzero(product >= -off), product.shape[1])
        if self.l1 and len(i) <= _DENSE * product.size:
            base, ones = self.z[at], np.ones(self.p.dims, dtype=np.float32)
            near = 2.0 * half + (self.p.dims + 32) * 2.0**-24 * 2.0 * most * 1.01 + 1e-30
            kept, held = np.empty(len(i), dtype=bool), np.empty((2, _PAIRS, self.p.dims), dtype=np.float32)
            for start in range(0, len(i), _PAIRS):
                part = slice(start, start + _PAIRS)
                gap, other = held[:, : len(i[part])]
                np.take(z, i[part], axis=0, out=gap, mode="clip")
                gap -= np.take(base, j[part], axis=0, out=other, mode="clip")
                kept[part] = np.abs(gap, out=gap) @ ones <= near[i[part]]
            i, j = i[kept], j[kept]
        return i, j


class _Block:
    """A box's points leaf after leaf, searched with a sieve (many dimensions)."""

    def __init__(self, ids: np.ndarray, cs: np.ndarray, at: np.ndarray, sizes: list[int], lo: np.ndarray, hi: np.ndarray, queries: list[np.ndarray], p, routes):
        self.ids, self.cs, self.at = ids, cs, at
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.lo, self.hi, self.p, self.routes = lo, hi, p, routes
        finite = all(np.isfinite(x.sum()) or np.isfinite(x).all() for x in (self.cs, *queries))
        with np.errstate(over="ignore"):
            finite = finite and np.isfinite(np.ptp([f([f(x) for x in (self.cs, *queries) if x.size]) for f in (np.min, np.max)]))
        self.sieve = _Sieve(self.cs, queries, p) if finite else None

    def search(self, rows: np.ndarray, qcs: np.ndarray, g: np.ndarray, limit: np.ndarray, margin: float, best: _Best, own: int = -1) -> None:
        """Puts what the queries (``qcs``, ``g``: those at ``rows`` of ``best``) have within ``limit`` into ``best``, the nearest leaves first.

        The leaf ``own`` is left out."""
        p = self.p
        near = _reached(g, slack(np.minimum(limit, best.d[rows, -1]), p) + margin, self.lo, self.hi)
        near = near[near != own]
        if not len(near):
            return
        gap = _gap(g, self.lo[near], self.hi[near], p, self.routes)
        block = near // max(1, _BLOCK_ROWS // p.leaf_rows)
        blocks, first = np.unique(block, return_index=True)
        least = np.minimum.reduceat(gap.min(axis=0), first)
        asked = self.sieve.asked(qcs) if self.sieve else ()
        for b in np.argsort(least, kind="stable"):
            radius = np.minimum(limit, best.d[rows, -1])
            reach = slack(radius, p) + margin
            if least[b] > reach.max():
                break
            mine = slice(first[b], first[b + 1] if b + 1 < len(first) else None)
            hit = gap[:, mine] <= reach[:, None]
            some, leaves = np.flatnonzero(hit.any(axis=1)), near[mine][hit.any(axis=0)]
            if not len(some):
                continue
            if leaves[-1] - leaves[0] < len(leaves):
                at = slice(self.ends[leaves[0]], self.ends[leaves[-1] + 1])
            else:
                at = np.concatenate([np.arange(self.ends[i], self.ends[i + 1]) for i in leaves])
            size = at.stop - at.start if isinstance(at, slice) else len(at)
            if self.sieve:
                i, j = self.sieve.pairs(*(x[some] for x in asked), slack(radius[some], p), at)
                if len(i) <= _DENSE * size * len(some):
                    i, j = some[i], j + at.start if isinstance(at, slice) else at[j]
                    d = _paired(qcs, i, self.cs, j, p)
                    kept = d <= radius[i]
                    best.merge_pairs(rows[i[kept]], d[kept], self.ids[j[kept]], self.at[j[kept]])
                    continue
            for leaf in leaves:
                part = slice(self.ends[leaf], self.ends[leaf + 1])
                found, d = _smallest(_distances(qcs[some], self.cs[part], p), p.k)
                best.merge(rows[some], d, self.ids[part][found], self.at[part][found])


def within_box(p: ScoreParams, routes: Routes) -> Callable:
    """A box's points (``id, c, home, box``) to its leaves, every point searched for neighbours in the whole box.

    A leaf's points are compared with each other; those whose ball leaves the leaf also with the leaves it touches, the nearest first.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, home, box = ids[order], table["home"][0].as_py(), table["box"][0].as_py()
        cs = table["c"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p.dims)[order]
        g = routes.space(cs, p.metric)
        margin = _margin(g, routes)
        cell_lo, cell_hi = routes.cells[box]
        leaves = leaves_of(g, cell_lo, cell_hi, p.leaf_rows)
        lo, hi = (np.array([f(g[rows], axis=0) for rows, _, _ in leaves]) for f in (np.min, np.max))
        best = _Best(len(ids), p)
        for rows, _, _ in leaves:
            d = _distances(cs[rows], cs[rows], p)
            np.fill_diagonal(d, np.inf)
            at, near = _smallest(d, p.k)
            found = rows[at]
            best.d[rows, : at.shape[1]], best.at[rows, : at.shape[1]] = near, found
            best.id[rows, : at.shape[1]] = ids[found]
        whole = None
        if many_dims(p) and len(leaves) > 1:
            rows = np.concatenate([x for x, _, _ in leaves])
            whole = _Block(ids[rows], cs[rows], rows, [len(x) for x, _, _ in leaves], lo, hi, [], p, routes)
        for i, (rows, free_lo, free_hi) in enumerate(leaves):
            out = ~_inside(g[rows], best.d[rows, -1], free_lo, free_hi, margin, p)
            if whole and out.any():
                whole.search(rows[out], cs[rows[out]], g[rows[out]], np.full(out.sum(), np.inf), margin, best, own=i)
            elif out.any():
                _search_leaves(rows[out], i, leaves, lo, hi, ids, cs, g, margin, best, p, routes)
        radius = best.d[:, -1]
        whole = None  # several times the box
        settled = _inside(g, radius, cell_lo, cell_hi, margin, p)
        made = [_leaf(rows, home, box, i, ids, cs, g, best, settled, radius, margin, routes, p) for i, (rows, _, _) in enumerate(leaves)]
        columns = []
        for name, kind in _LEAF_TYPES:
            columns.append(pa.array([m.pop(name) for m in made], type=kind))
        return pa.table(columns, names=[name for name, _ in _LEAF_TYPES])

    return run


_LISTS = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_LEAF_TYPES = [
    (name, pa.list_(_LISTS[kind[6:-1]]) if kind.startswith("array") else _LISTS[kind])
    for name, kind in (column.split() for column in LEAF.split(", "))
]


def _inside(g, radius, lo, hi, margin, p) -> np.ndarray:
    """Whether the ball of each point lies in the free space between ``lo`` and ``hi``."""
    if np.isinf(lo).all() and np.isinf(hi).all():  # nothing is outside
        return np.ones(len(g), dtype=bool)
    reach = (slack(radius, p) + margin)[:, None]
    return ((g - reach > lo) & (g + reach < hi)).all(axis=1)


def _reached(g: np.ndarray, reach: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The boxes [lo, hi] that the hull of the balls around ``g`` reaches into."""
    low, high = (g - reach[:, None]).min(axis=0), (g + reach[:, None]).max(axis=0)
    return np.flatnonzero(((lo <= high) & (hi >= low)).all(axis=1))


def _search_leaves(rows, own, leaves, lo, hi, ids, cs, g, margin, best, p, routes) -> None:
    """Only the leaves that the rows' balls reach are looked at, so that a leaf's work does not grow with its box."""
    near = _reached(g[rows], slack(best.d[rows, -1], p) + margin, lo, hi)
    near = near[near != own]
    gap = _gap(g[rows], lo[near], hi[near], p, routes)
    least = gap.min(axis=0)
    for i in np.argsort(least, kind="stable"):
        reach = slack(best.d[rows, -1], p) + margin
        if least[i] > reach.max():
            break
        some = np.flatnonzero(gap[:, i] <= reach)
        if not len(some):
            continue
        other, of = leaves[near[i]][0], rows[some]
        at, found = _smallest(_distances(cs[of], cs[other], p), p.k)
        best.merge(of, found, ids[other[at]], other[at])


def _leaf(rows, home, box, i, ids, cs, g, best, settled, radius, margin, routes, p) -> dict:
    has = np.isfinite(best.d[rows])
    at = best.at[rows][has]
    open_rows = rows[~settled[rows]]
    touch = np.zeros(0, dtype=np.int64)
    if len(open_rows):
        reach = (slack(radius[open_rows], p) + margin)[:, None]
        hull = (g[open_rows] - reach).min(axis=0)[None], (g[open_rows] + reach).max(axis=0)[None]
        _, touch = routes.touched(routes.root[home], *hull)
        touch = touch[touch != box]
    return {
        "box": box, "node": (box << 32) + i, "home": home, "ids": ids[rows], "cs": cs[rows].ravel(),
        "lo": g[rows].min(axis=0), "hi": g[rows].max(axis=0), "n": has.sum(axis=1), "nids": ids[at], "nds": best.d[rows][has],
        "ncs": cs[at[:0] if many_dims(p) else at].ravel(), "settled": settled[rows], "oids": ids[open_rows], "ocs": cs[open_rows].ravel(),
        "ogs": g[open_rows].ravel(), "ors": radius[open_rows], "touch": np.sort(touch),
    }


def _values(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def listed_dims(p: ScoreParams) -> int:
    """How many coordinates of a neighbour are in a list."""
    return 0 if many_dims(p) else p.dims


def points_of(p: ScoreParams) -> Callable:
    """Leaves to one row per point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                ids = _values(col["ids"], i)
                yield _rows(
                    ids, _values(col["n"], i), _values(col["nids"], i), _values(col["nds"], i), _values(col["ncs"], i), listed_dims(p),
                    _lists(_values(col["cs"], i), np.arange(len(ids) + 1) * p.dims),
                    pa.array([col["home"][i].as_py()] * len(ids), type=pa.string()), pa.array(_values(col["settled"], i)),
                )

    return run


def asks_of(p: ScoreParams, routes: Routes) -> Callable:
    """A leaf's open points (``oids``, ...) and the leaves of a box they may reach (``nodes, los, his``) to packed queries per reached leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            out = {name: [] for name in ("node", "qids", "qcs", "qrs", "m")}
            for i in range(batch.num_rows):
                ids, r = _values(col["oids"], i), _values(col["ors"], i)
                cs, g = (_values(col[name], i).reshape(len(ids), -1) for name in ("ocs", "ogs"))
                nodes = _values(col["nodes"], i)
                lo, hi = (_values(col[name], i).reshape(len(nodes), -1) for name in ("los", "his"))
                hit = _gap(g, lo, hi, p, routes) <= (slack(r, p) + _margin(np.concatenate([g, lo, hi]), routes))[:, None]
                for j in np.flatnonzero(hit.any(axis=0)):
                    some = hit[:, j]
                    for name, value in (("node", nodes[j]), ("qids", ids[some]), ("qcs", cs[some].ravel()), ("qrs", r[some]), ("m", some.sum())):
                        out[name].append(value)
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out.values(), kinds)], names=list(out))

    return run


def search_leaves(p: ScoreParams) -> Callable:
    """Packed queries against a leaf (``qids, qcs, qrs, ids, cs``): of all that a task finds, the k best of each point leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = kept = 0
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                qids, ids = _values(col["qids"], i), _values(col["ids"], i)
                qcs, cs = _values(col["qcs"], i).reshape(-1, p.dims), _values(col["cs"], i).reshape(-1, p.dims)
                d = _distances(qcs, cs, p)
                d[d > _values(col["qrs"], i)[:, None]] = np.inf
                at, near = _smallest(d, p.k)
                has = np.isfinite(near)
                found = at[has]
                held.append((np.repeat(qids, has.sum(axis=1)), near[has], ids[found], cs[found]))
                rows += len(found)
                if rows > max(2 * kept, 16 * _FLUSH_ROWS):
                    held = [_best_of(held, p)]
                    rows = kept = len(held[0][0])
        if held:
            own, d, nid, nc = _best_of(held, p)
            ids, n = np.unique(own, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(n)])
            for start in range(0, len(ids), _FLUSH_ROWS):
                part = slice(ends[start], ends[min(start + _FLUSH_ROWS, len(ids))])
                yield _rows(ids[start : start + _FLUSH_ROWS], n[start : start + _FLUSH_ROWS], nid[part], d[part], nc[part].ravel(), p.dims)

    return run


def search_box(p: ScoreParams, routes: Routes) -> Callable:
    """Packed queries of other boxes' leaves (``oids, ocs, ogs, ors``) against a whole box (its leaves' ``ids, cs, lo, hi``), for many dimensions.

    Only the k best of each query leave the task. A query's ball shrinks while it is searched, the nearest leaves first.
    """

    def run(asked: pa.Table, box: pa.Table) -> pa.Table:
        out = []
        asked, box = asked.combine_chunks(), box.combine_chunks()
        if box.num_rows and asked.num_rows:
            ids, cs = (box[c].chunk(0).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "cs"))
            sizes = [len(box["ids"][i]) for i in range(box.num_rows)]
            lo, hi = (np.array([_values(box[c], i) for i in range(box.num_rows)]) for c in ("lo", "hi"))
            queries = [_values(asked["ocs"], i).reshape(-1, p.dims) for i in range(asked.num_rows)]
            whole = _Block(ids, cs.reshape(-1, p.dims), ids, sizes, lo, hi, queries, p, routes)
        for i in range(asked.num_rows if box.num_rows else 0):
            qids, radius = _values(asked["oids"], i), _values(asked["ors"], i)
            g = _values(asked["ogs"], i).reshape(len(qids), -1)
            best = _Best(len(qids), p)
            whole.search(np.arange(len(qids)), queries[i], g, radius, _margin(np.concatenate([g, lo, hi]), routes), best)
            has = np.isfinite(best.d) & (best.d <= radius[:, None])
            n = has.sum(axis=1)
            if n.any():
                out.append(_rows(qids[n > 0], n[n > 0], best.id[has], best.d[has], np.zeros(0), 0))
        none = _rows(*(np.zeros(0, dtype=kind) for kind in ("i8", "i8", "i8", "f8", "f8")), 0)
        return pa.Table.from_batches(out or [none])

    return run


def _best_of(held: list[tuple], p: ScoreParams) -> tuple:
    """The k best (by distance, then id) of each point, in the order of the points' ids."""
    own, d, nid, nc = (np.concatenate(part) for part in zip(*held))
    order = np.lexsort((nid, d, own))
    own = own[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    order = order[rank < p.k]
    return own[rank < p.k], d[order], nid[order], nc[order]


def _distances(a: np.ndarray, b: np.ndarray, p: ScoreParams) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    gap, size = np.empty_like(total), np.abs if p.metric == "l1" else np.square
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for i in range(p.dims):
        np.subtract(a[i, :, None], b[i], out=gap)
        total += size(gap, out=gap)
    return _rounded(total, p)


def _rounded(total: np.ndarray, p: ScoreParams) -> np.ndarray:
    if p.metric == "l2":
        np.sqrt(total, out=total)
    if p.dist_scale is not None:
        unit = float(10**p.dist_scale)
        total = np.floor(total * unit + 0.5) / unit
    return total


def _paired(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, p: ScoreParams) -> np.ndarray:
    """The distances of a[i] and b[j], bit by bit those of :func:`_distances`."""
    out, size = np.empty(len(i)), np.abs if p.metric == "l1" else np.square
    for start in range(0, len(i), _PAIRS):
        part = slice(start, start + _PAIRS)
        gap = a[i[part]] - b[j[part]]
        total = np.zeros(len(gap))
        for x in np.ascontiguousarray(size(gap, out=gap).T):
            total += x
        out[part] = _rounded(total, p)
    return out


def _smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k smallest per row; equal values in column (id) order."""
    k = min(k, d.shape[1])
    if k > 16:
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(d, at, axis=1)
    rows = np.arange(len(d))
    at = np.empty((len(d), k), dtype=np.int64)
    best = np.empty((len(d), k))
    for j in range(k):
        at[:, j] = d.argmin(axis=1)
        best[:, j] = d[rows, at[:, j]]
        d[rows, at[:, j]] = np.inf
    return at, best


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.ascontiguousarray(values)))


def _rows(ids, n, nid, nd, nc, dims: int, *more: pa.Array) -> pa.RecordBatch:
    """Rows of RESULT, or of POINT with ``more``; ``n`` neighbours of each point follow each other."""
    ends = np.concatenate([[0], np.cumsum(n)])
    columns = [pa.array(ids), _lists(nid, ends), _lists(nd, ends), _lists(nc, ends * dims), *more]
    return pa.RecordBatch.from_arrays(columns, names=["id", "nid", "nd", "nc", "c", "home", "settled"][: len(columns)])
