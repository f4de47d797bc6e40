"""Boxes for the neighbour search: a routing table from a sample, corrected by exact counts.

The routing table is a kd-tree over a bounded sample of the points. The points are then counted per box, in the
tasks that read them (a table that one task could hold needs no counts). Boxes above the size of a task are cut again by samples of their own, which stay in the tasks; boxes that hold too few
points give them to their neighbours. Only then are the points shuffled, once, by box. Inside a task
a box is cut further into leaves (:func:`leaves_of`), so that no level of the tree costs a shuffle.

With more than ``PIVOTS_FROM`` dimensions boxes are not boxes of coordinates but of distances to a few pivots:
by the triangle inequality two points are at least as far apart as their distances to any pivot differ.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outskirt.params import ScoreParams

# Rows of a sample that pass the driver, and the fewest of them that a box is cut for.
SAMPLE_ROWS = 1 << 16
SAMPLE_PER_BOX = 16
# Most numbers (coordinates, id and list heads) that a task should hold.
TASK_VALUES = 1 << 21
# Beyond this many boxes (some 100 bytes each in the routing table) boxes grow instead.
MOST_BOXES = 1 << 19
PIVOTS_FROM, PIVOTS = 8, 12
_PIVOT_ROWS = 2048


@dataclass
class Routing:
    """A kd-tree per group: node i is inner where ``dim[i] >= 0``; left of ``cut[i]`` lies what is below it. Boxes are nodes without a cut.

    ``lo`` and ``hi`` bound a node's cell: no point of the group outside the cell lies strictly within them.
    """

    groups: list[str]
    dims: int
    pivots: np.ndarray | None = None
    dim: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    lo: list[np.ndarray] = field(default_factory=list)
    hi: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        for _ in self.groups:
            self._add(np.full(self.dims, -np.inf), np.full(self.dims, np.inf))
        self.root = {name: i for i, name in enumerate(self.groups)}

    def _add(self, lo: np.ndarray, hi: np.ndarray) -> int:
        for column, value in ((self.dim, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.lo, lo), (self.hi, hi)):
            column.append(value)
        return len(self.dim) - 1

    def split(self, node: int, sample: np.ndarray, parts: int) -> None:
        """Cut ``node`` into up to ``parts`` boxes of near-equal shares of ``sample``."""
        todo = [(node, sample, parts)]
        while todo:
            node, rows, parts = todo.pop()
            found = cut_of(rows) if parts > 1 and len(rows) >= 2 else None
            if found is None:
                continue
            dim, cut = found
            low = rows[:, dim] < cut
            lo, hi = self.lo[node].copy(), self.hi[node].copy()
            lo[dim] = hi[dim] = cut
            self.dim[node], self.cut[node] = dim, cut
            self.left[node], self.right[node] = self._add(self.lo[node], hi), self._add(lo, self.hi[node])
            for child, own in ((self.left[node], rows[low]), (self.right[node], rows[~low])):
                todo.append((child, own, round(parts * len(own) / len(rows))))

    def graft(self, node: int, dim: list[int], cut: list[float], left: list[int], right: list[int]) -> None:
        """Put a tree whose root is its node 0 in the place of the box ``node``."""
        ids = [node, *(self._add(self.lo[node], self.hi[node]) for _ in dim[1:])]
        for i, at in enumerate(ids):
            self.dim[at], self.cut[at] = dim[i], cut[i]
            self.left[at], self.right[at] = (ids[x] if x >= 0 else -1 for x in (left[i], right[i]))

    def settle(self, counts: dict[int, int], most: int, least: int) -> dict[int, int]:
        """Drop cuts whose two sides fit one box, and cuts around boxes below ``least``: their points go where the other side's cuts say."""
        sizes = dict(counts)

        def visit(node: int) -> tuple[int, int]:
            """The node to use instead, and its size."""
            if self.dim[node] < 0:
                return node, sizes.get(node, 0)
            (a, n), (b, m) = visit(self.left[node]), visit(self.right[node])
            self.left[node], self.right[node] = a, b
            if n + m <= most:
                self.dim[node] = -1
                sizes[node] = n + m
                return node, n + m
            if self.dim[a] < 0 and n < least:
                return b, n + m
            if self.dim[b] < 0 and m < least:
                return a, n + m
            return node, n + m

        for i in self.root.values():
            at, _ = visit(i)
            if at != i:  # the root stays the first node of its group
                for column in (self.dim, self.cut, self.left, self.right):
                    column[i] = column[at]
                if self.dim[i] < 0:
                    sizes[i] = sizes.get(at, 0)
        self._cells()
        return {node: sizes.get(node, 0) for node in self.boxes()}

    def _cells(self) -> None:
        todo = list(self.root.values())
        for i in todo:
            self.lo[i], self.hi[i] = np.full(self.dims, -np.inf), np.full(self.dims, np.inf)
        while todo:
            node = todo.pop()
            if (d := self.dim[node]) < 0:
                continue
            a, b = self.left[node], self.right[node]
            self.lo[a], self.hi[a] = self.lo[node], self.hi[node].copy()
            self.lo[b], self.hi[b] = self.lo[node].copy(), self.hi[node]
            self.hi[a][d] = self.lo[b][d] = self.cut[node]
            todo += [a, b]

    def boxes(self) -> list[int]:
        out, todo = [], list(self.root.values())
        while todo:
            node = todo.pop()
            if self.dim[node] < 0:
                out.append(node)
            else:
                todo += [self.left[node], self.right[node]]
        return out

    def frozen(self) -> "Routes":
        return Routes(
            dict(self.root), self.pivots, np.array(self.dim), np.array(self.cut), np.array(self.left), np.array(self.right),
            {i: (self.lo[i], self.hi[i]) for i in self.boxes()},
        )


@dataclass
class Routes:
    """A routing table as arrays, for tasks."""

    root: dict[str, int]
    pivots: np.ndarray | None
    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cells: dict[int, tuple[np.ndarray, np.ndarray]]

    def place(self, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The box of each row of ``g``, whose group's root is ``at``."""
        at = at.copy()
        while len(rows := np.flatnonzero(self.dim[at] >= 0)):
            node = at[rows]
            low = g[rows, self.dim[node]] < self.cut[node]
            at[rows] = np.where(low, self.left[node], self.right[node])
        return at

    def touched(self, root: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, box) for every box whose cell the row's hull [lo, hi] reaches into."""
        row, at = np.arange(len(lo)), np.full(len(lo), root)
        rows, boxes = [], []
        while len(row):
            d = self.dim[at]
            done = d < 0
            rows.append(row[done])
            boxes.append(at[done])
            row, at, d = row[~done], at[~done], d[~done]
            low, high = lo[row, d] <= self.cut[at], hi[row, d] >= self.cut[at]
            row, at = np.concatenate([row[low], row[high]]), np.concatenate([self.left[at[low]], self.right[at[high]]])
        return np.concatenate(rows), np.concatenate(boxes)

    def space(self, cs: np.ndarray, metric: str) -> np.ndarray:
        """The coordinates that boxes are made of."""
        if self.pivots is None:
            return cs
        return np.stack([length(cs - pivot, metric) for pivot in self.pivots], axis=1)


def length(gaps: np.ndarray, metric: str) -> np.ndarray:
    return np.abs(gaps).sum(axis=1) if metric == "l1" else np.sqrt((gaps * gaps).sum(axis=1))


def cut_of(rows: np.ndarray) -> tuple[int, float] | None:
    """Dimension and value that part ``rows`` in two near the middle of their longest side; None if they all coincide."""
    sides = rows.max(axis=0) - rows.min(axis=0)
    dim = int(sides.argmax())
    if not sides[dim] > 0:
        return None
    values = np.sort(rows[:, dim])
    cut = values[len(values) // 2]
    if cut == values[0]:
        cut = values[np.searchsorted(values, cut, side="right")]
    return dim, float(cut)


def leaves_of(g: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> list[tuple]:
    """(rows, free_lo, free_hi) of the leaves of a box with the points ``g`` and the cell [lo, hi]; rows ascend.

    A leaf has at most ``most`` points, unless they all coincide.
    """
    out, todo = [], [(np.arange(len(g)), lo, hi)]
    while todo:
        rows, lo, hi = todo.pop()
        found = cut_of(g[rows]) if len(rows) > most else None
        if found is None:
            out.append((rows, lo, hi))
            continue
        dim, cut = found
        x = g[rows, dim]
        low = x < cut
        left_hi, right_lo = hi.copy(), lo.copy()
        left_hi[dim], right_lo[dim] = cut, x[low].max()
        todo += [(rows[low], lo, left_hi), (rows[~low], right_lo, hi)]
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


ROUTED = "id bigint, c array<double>, home string, box bigint"


def _routed(routes: Routes, p: ScoreParams, count: bool, only: frozenset | None = None):
    def run(batches):
        for batch in batches:
            groups = np.array([routes.root[h] for h in batch.column("home").to_pylist()], dtype=np.int64)
            g = routes.space(_matrix(batch.column("c"), p.dims), p.metric)
            box = routes.place(groups, g)
            if count:
                boxes, n = np.unique(box, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(boxes), pa.array(n)], names=["box", "n"])
            else:
                made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(box)], names=[*batch.schema.names, "box"])
                yield made if only is None else made.filter(pa.array(np.isin(box, list(only))))

    return run


def routed(points: DataFrame, routes: Routes, p: ScoreParams) -> DataFrame:
    """``points`` (``id, c, home``) with their ``box``."""
    return points.mapInArrow(_routed(routes, p, False), ROUTED)


def _counted(points: DataFrame, routing: Routing, p: ScoreParams) -> dict[int, int]:
    found = points.mapInArrow(_routed(routing.frozen(), p, True), "box bigint, n bigint")
    table = found.groupBy("box").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(table["box"].to_pylist(), table["n"].to_pylist()))


def _sampled(points: DataFrame, rows: int) -> tuple[np.ndarray, list[str]]:
    """Coordinates and groups of about ``SAMPLE_ROWS`` of ``rows`` points, chosen by a hash of the id."""
    if rows > SAMPLE_ROWS:
        points = points.where(f"pmod(xxhash64(id, 42), {2**40}) < {int(2**40 * SAMPLE_ROWS / rows)}")
    table = points.select("c", "home").toArrow()
    return table["c"].combine_chunks().flatten().to_numpy(zero_copy_only=False), table["home"].to_pylist()


def choose_pivots(sample: np.ndarray, metric: str) -> np.ndarray:
    """Points of the sample far from each other: each the one farthest from those before."""
    sample = sample[:_PIVOT_ROWS]
    chosen = [int(length(sample - sample.mean(axis=0), metric).argmax())]
    far = length(sample - sample[chosen[0]], metric)
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, length(sample - sample[chosen[-1]], metric))
    return sample[chosen]


def many_dims(p: ScoreParams) -> bool:
    """Whether boxes are made of distances to pivots; they prune little there, so lists travel without coordinates."""
    return p.dims > PIVOTS_FROM


def task_rows(p: ScoreParams) -> int:
    return max(4 * p.leaf_rows, TASK_VALUES // (p.dims + 4))


def routing_table(points: DataFrame, rows: int, groups: list[str], p: ScoreParams, tasks: int) -> tuple[Routes, int]:
    """The routing table of ``points`` (``id, c, home``), and its number of boxes.

    At least some ``3 * tasks`` boxes, where they then hold a leaf or more, and none above twice :func:`task_rows`, unless
    its points coincide or there are ``MOST_BOXES``.
    """
    most = max(p.leaf_rows, min(task_rows(p), -(-rows // (3 * tasks))))
    flat, homes = _sampled(points, rows)
    sample = flat.reshape(-1, p.dims)
    pivots = choose_pivots(sample, p.metric) if many_dims(p) and len(sample) else None
    routing = Routing(groups, p.dims if pivots is None else len(pivots), pivots)
    # Where one task could hold all points, the sample's own counts will do.
    exact = rows <= max(SAMPLE_ROWS, task_rows(p))
    g = routing.frozen().space(sample, p.metric)
    share = 1 if rows <= SAMPLE_ROWS else SAMPLE_PER_BOX
    for name, node in routing.root.items():
        own = g[[h == name for h in homes]] if len(groups) > 1 else g
        routing.split(node, own, min(math.ceil(rows * len(own) / max(len(sample), 1) / most), len(own) // share))
    least = max(p.k + 1, p.leaf_rows // 4)
    while True:
        if exact:
            roots = np.array([routing.root[h] for h in homes], dtype=np.int64)
            boxes, n = np.unique(routing.frozen().place(roots, g), return_counts=True)
            counts = dict(zip(boxes.tolist(), (n * (rows / max(len(sample), 1))).round().astype(int).tolist()))
        else:
            counts = _counted(points, routing, p)
        sizes = routing.settle(counts, most, least)
        large = {b: math.ceil(n / most) for b, n in sizes.items() if n > 2 * most}
        if exact or not large or len(sizes) >= MOST_BOXES or not _cut_large(points, routing, large, most, p):
            return routing.frozen(), len(sizes)


def _cut_large(points: DataFrame, routing: Routing, large: dict[int, int], most: int, p: ScoreParams) -> bool:
    """Cut each of the ``large`` boxes into that many by a sample of its own, in the tasks; whether any could be cut."""
    routes = routing.frozen()

    def cuts(table: pa.Table) -> pa.Table:
        box, own = table["box"][0].as_py(), Routing([""], routing_dims)
        own.split(0, routes.space(_matrix(table["c"].combine_chunks(), p.dims), p.metric), large[box])
        columns = [pa.array([v], type=pa.list_(t)) for v, t in zip((own.dim, own.cut, own.left, own.right), kinds)]
        return pa.table([pa.array([box]), *columns], names=["box", "dim", "cut", "left", "right"])

    kinds, routing_dims = (pa.int64(), pa.float64(), pa.int64(), pa.int64()), routing.dims
    chosen = points.where(f"pmod(xxhash64(id, 43), {2**40}) < {int(2**40 * min(1.0, 2 * SAMPLE_PER_BOX / most))}")
    inside = chosen.mapInArrow(_routed(routes, p, False, frozenset(large)), ROUTED)
    shape = "box bigint, dim array<bigint>, cut array<double>, left array<bigint>, right array<bigint>"
    grown = False
    for row in inside.groupBy("box").applyInArrow(cuts, shape).toArrow().to_pylist():
        grown |= len(row["dim"]) > 1
        routing.graft(row["box"], row["dim"], row["cut"], row["left"], row["right"])
    return grown
