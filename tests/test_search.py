"""How the neighbour search goes about it: shuffles, boxes, the walk across borders, chunks, pivots."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import brute_force

from outskirt import ScoreParams
from outskirt.operators import blocks, joins, knn
from outskirt.plans import kd_tree


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, c array<double>")


def uniform(n, dims, seed=1):
    rng = random.Random(seed)
    return [(i, [round(rng.random() * 100, 4) for _ in range(dims)]) for i in range(n)]


def small_boxes(monkeypatch):
    """Samples and tasks so small that the routing table is made in several rounds, by exact counts."""
    monkeypatch.setattr(kd_tree, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(kd_tree, "TASK_VALUES", 300)


def check(spark, rows, p):
    want = brute_force([r[0] for r in rows], [r[1] for r in rows], p)
    got = {r.id: (list(r.nid), list(r.nd)) for r in knn.exact_knn(table(spark, rows), p).collect()}
    assert got == {i: (w[0], w[1]) for i, w in want.items()}


@pytest.mark.parametrize("dims, metric", [(2, "l2"), (12, "l1"), (12, "l2")])
def test_many_rounds_of_cuts(spark, monkeypatch, dims, metric):
    small_boxes(monkeypatch)
    rows = uniform(1500, dims) + [(10_000 + i, [50.0 + i % 7 / 1e4] * dims) for i in range(400)]
    check(spark, rows, ScoreParams(k=3, dims=dims, leaf_rows=12, metric=metric))


def test_boxes_hold_what_a_task_may(spark, monkeypatch):
    small_boxes(monkeypatch)
    p = ScoreParams(k=3, leaf_rows=12)
    points = table(spark, uniform(3000, 2)).selectExpr("id", "c", "'' as home")
    routes, boxes = kd_tree.routing_table(points, 3000, [""], p, 2)
    sizes = [r["count"] for r in kd_tree.routed(points, routes, p).groupBy("box").count().collect()]
    most = max(12, min(kd_tree.task_rows(p), 500))
    assert len(sizes) == boxes and sum(sizes) == 3000
    assert max(sizes) <= 2 * most and min(sizes) > p.k


def test_two_shuffles_before_the_leaves(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    plans, keep = [], knn.keep
    monkeypatch.setattr(knn, "keep", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    reps = knn.representatives(table(spark, uniform(5000, 2)), 3, 2)
    knn.nearest_neighbors(reps.select("id", "c"), ScoreParams(k=3, leaf_rows=20))
    # The first two tables kept: the representatives, and the leaves.
    assert "FlatMapGroupsInArrow" in plans[1]
    assert sum(len(re.findall(r"Exchange (?:hash|range|Round|Single)", x)) for x in plans[:2]) - plans[0].count("Exchange") // 2 <= 2


def test_the_walk_grows_with_the_leaves(spark):
    rows = {}
    for n in (2000, 8000):
        p = ScoreParams(k=3, leaf_rows=16)
        leaves = knn.searched_leaves(table(spark, uniform(n, 2)), p, n)
        walk = leaves.table.selectExpr("count(1) as leaves", "sum(size(touch)) as steps", "max(size(touch)) as most").first()
        rows[n] = walk
        assert walk.steps <= 3 * walk.leaves
    assert rows[8000].steps < 5 * rows[2000].steps


def test_a_hub_is_met_in_chunks(spark):
    p = ScoreParams(k=2, leaf_rows=10)
    asked = [(7, [100 * i + j for j in range(4)], [float(i), 0.0] * 4, [1.0] * 4, 4) for i in range(200)]
    asked += [(8, [1], [0.0, 0.0], [1.0], 1)]
    got = knn.chunked(spark.createDataFrame(asked, blocks.ASK), p).collect()
    hub = [r for r in got if r.node == 7]
    assert len(hub) > 40 and sum(len(r.qids) for r in hub) == 800 and max(len(r.qids) for r in hub) <= 8 * p.leaf_rows
    assert sorted(i for r in hub for i in r.qids) == sorted(i for a in asked[:-1] for i in a[1])
    assert [(r.chunk, list(r.qids)) for r in got if r.node == 8] == [(0, [1])]


def test_at_most_k_rows_per_point_leave_a_task():
    p, rng = ScoreParams(k=3), np.random.default_rng(1)
    queries, out = np.array([[float(i), 0.0] for i in range(5)]), []
    leaves = [(np.arange(20) + 20 * j, rng.random((20, 2))) for j in range(30)]
    rows = [
        {"qids": list(range(5)), "qcs": queries.ravel().tolist(), "qrs": [np.inf] * 5, "ids": ids.tolist(), "cs": cs.ravel().tolist()}
        for ids, cs in leaves
    ]
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=4)
    for batch in blocks.search_leaves(p)(iter(batches)):
        out += batch.to_pylist()
    assert [r["id"] for r in out] == list(range(5)) and all(len(r["nid"]) == 3 for r in out)
    all_ids, all_cs = np.concatenate([i for i, _ in leaves]), np.concatenate([c for _, c in leaves])
    for r, q in zip(out, queries):
        d = np.floor(np.sqrt(((all_cs - q) ** 2).sum(axis=1)) * 100 + 0.5) / 100
        assert r["nid"] == all_ids[np.lexsort((all_ids, d))[:3]].tolist()


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_pivots_prune_clustered_vectors(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    centres = rng.random((20, 64)) * 100
    rows = [(i, (centres[i % 20] + rng.normal(0, 1, 64)).round(3).tolist()) for i in range(1600)]
    p = ScoreParams(k=3, dims=64, metric=metric, leaf_rows=40)
    pairs, distances = [], blocks._distances
    monkeypatch.setattr(blocks, "_distances", lambda a, b, p: pairs.append(len(a) * len(b)) or distances(a, b, p))
    # The search of one box with all points: what a task does.
    points = table(spark, rows).selectExpr("id", "c", "'' as home")
    routes, _ = kd_tree.routing_table(points, 1600, [""], p.with_(leaf_rows=1600), 1)
    kd = {"id": [r[0] for r in rows], "c": [r[1] for r in rows], "home": [""] * 1600, "box": [0] * 1600}
    box = routes.place(np.zeros(1, dtype=np.int64), routes.space(np.array([rows[0][1]]), metric))[0]
    found = blocks.within_box(p, routes)(pa.table(kd).set_column(3, "box", pa.array([int(box)] * 1600)))
    assert sum(pairs) < 1600 * 1600 / 3
    want = brute_force([r[0] for r in rows], [r[1] for r in rows], p)
    for leaf in found.to_pylist():
        at = 0
        for i, n in zip(leaf["ids"], leaf["n"]):
            assert (leaf["nids"][at : at + n], leaf["nds"][at : at + n]) == want[i][:2]
            at += n


def test_many_dimensions_ask_whole_boxes(spark, monkeypatch):
    """Queries are not written once per leaf, nor neighbours' coordinates with every list."""
    small_boxes(monkeypatch)
    monkeypatch.setattr(knn, "asks", lambda *_: pytest.fail("a row per leaf that asks and leaf that is asked"))
    p = ScoreParams(k=3, dims=12, leaf_rows=12)
    rows = uniform(700, 12, seed=4) + [(10_000 + i, [50.0] * 12) for i in range(20)]
    points = table(spark, rows)
    leaves = knn.searched_leaves(points, p, len(rows))
    assert leaves.boxes > 5 and leaves.open_points > len(rows) // 2
    assert leaves.table.selectExpr("sum(size(ncs))").first()[0] == 0
    want, at = brute_force([r[0] for r in rows], [r[1] for r in rows], p), dict(rows)
    got = knn.exact_knn(points, p).collect()
    assert {r.id: (list(r.nid), list(r.nd)) for r in got} == {i: (w[0], w[1]) for i, w in want.items()}
    assert all(list(r.nc) == [x for i in r.nid for x in at[i]] for r in got)


def test_a_leafs_work_does_not_grow_with_its_box(monkeypatch):
    p, gap, cells = ScoreParams(k=3, leaf_rows=16), blocks._gap, {}
    for n in (2000, 8000):
        rows, seen = uniform(n, 2), []
        monkeypatch.setattr(blocks, "_gap", lambda g, lo, *rest: seen.append(len(g) * len(lo)) or gap(g, lo, *rest))
        box = {"id": [r[0] for r in rows], "c": [r[1] for r in rows], "home": [""] * n, "box": [0] * n}
        blocks.within_box(p, kd_tree.Routing([""], 2).frozen())(pa.table(box))
        cells[n] = sum(seen)
    assert 0 < cells[8000] < 5 * cells[2000]


def spread_out(n, dims=64, seed=7):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_spread_out_vectors_are_hardly_measured(monkeypatch, metric):
    """Pivots rule out next to none of these pairs."""
    n, p, pairs = 3000, ScoreParams(k=3, dims=64, metric=metric, leaf_rows=100), []
    x, dense, single = spread_out(n), blocks._distances, getattr(blocks, "_paired", None)
    monkeypatch.setattr(blocks, "_distances", lambda a, b, p: pairs.append(len(a) * len(b)) or dense(a, b, p))
    if single:
        monkeypatch.setattr(blocks, "_paired", lambda a, i, b, j, p: pairs.append(len(i)) or single(a, i, b, j, p))
    routes = kd_tree.Routing([""], 12, kd_tree.choose_pivots(x, metric)).frozen()
    box = {"id": np.arange(n), "c": x.tolist(), "home": [""] * n, "box": np.zeros(n, dtype=np.int64)}
    found = blocks.within_box(p, routes)(pa.table(box))
    assert sum(pairs) < n * n / 8
    pairs.clear()
    # Those of another box: each leaf's points as queries with a radius.
    queries = spread_out(500, seed=8)
    d = dense(queries, x, p)
    radius = np.sort(d, axis=1)[:, 5]
    asked = {"oids": [np.arange(500) + n], "ocs": [queries.ravel()], "ogs": [routes.space(queries, metric).ravel()], "ors": [radius]}
    out = {r["id"]: (r["nid"], r["nd"]) for r in blocks.search_box(p, routes)(pa.table(asked), found).to_pylist()}
    assert sum(pairs) < 500 * n / 8
    for i in range(500):
        near = np.argsort(d[i], kind="stable")[:3]
        assert out[n + i] == (near.tolist(), d[i][near].tolist())


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("kind", ["plain", "far off", "one far out", "few values", "equal", "tiny", "huge", "one side", "flat"])
def test_a_sieve_loses_no_pair(metric, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 20))
    if kind == "far off":
        x = 1e7 + x
    elif kind == "one far out":
        x[5], x[6, 3] = 1e9, -1e15
    elif kind == "few values":
        x = np.round(x)
    elif kind == "equal":
        x = np.full_like(x, 0.1)
    elif kind in ("tiny", "huge"):
        x *= {"tiny": 1e-305, "huge": 1e150}[kind]
    elif kind == "one side":
        x = np.exp(3 * x)
    elif kind == "flat":
        x[:, 4:] = 3.0
    p = ScoreParams(k=3, dims=20, metric=metric, dist_scale=None)
    q, cs = x[:100], x[50:]
    sieve = blocks._Sieve(cs, [q], p)
    d = blocks._distances(q, cs, p)
    for rank in (0, 3, 40, 300):
        radius = np.sort(d, axis=1)[:, rank]
        i, j = sieve.pairs(*sieve.asked(q), blocks.slack(radius, p), slice(0, len(cs)))
        hit = np.zeros(d.shape, dtype=bool)
        hit[i, j] = True
        assert hit[d <= radius[:, None]].all()
        assert kind not in ("plain", "far off", "one side") or hit.sum() < d.size * (rank + 250) / len(cs)
    assert (blocks._paired(q, i, cs, j, p) == d[i, j]).all()
