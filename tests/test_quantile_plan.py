"""Plans by quantiles against ranks of sorted values."""

import bisect
import collections

import numpy as np
import pytest

from outskirt.params import ScoreParams
from outskirt.plans import quantile_plan as module
from outskirt.plans.grid_plan import assign_partitions, partition_plan
from outskirt.plans.quantile_plan import quantile_plan, selected


def table(spark, values):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(values)], "id bigint, c array<double>")


def brute(rows, order, buckets, k):
    """Path of each row: sorted values, cut at ranks ceil(j n / buckets)."""
    nodes = {i: "" for i in range(len(rows))}
    for dim in order:
        members = collections.defaultdict(list)
        for i, node in nodes.items():
            members[node].append(i)
        for node, ids in members.items():
            n, values = len(ids), sorted(float(rows[i][dim]) for i in ids)
            if n > 2 * k + 1:
                cuts = sorted({values[-(-j * n // buckets) - 1] for j in range(1, buckets)} - {values[-1]})
                for i in ids:
                    nodes[i] = node + f"{bisect.bisect_left(cuts, float(rows[i][dim])):04x}"
    return nodes


def kinds(n):
    rng = np.random.default_rng(3)
    hot = rng.normal(50, 20, (n, 3))
    hot[: n // 3] = [10.0, 20.0, 30.0]
    few = rng.integers(0, 4, (n, 3)) * 25
    return {"spread": rng.uniform(0, 100, (n, 3)), "hot": hot, "few": few, "one": np.full((n, 3), 7.0), "signs": rng.choice([-0.0, 0.0, 1.0], (n, 3))}


@pytest.mark.parametrize("name, parts", [("spread", 256), ("hot", 4), ("few", 256), ("one", 256), ("signs", 256)])
def test_plan_equals_ranks(spark, name, parts, monkeypatch):
    """With few parts of a sketch, ranks need several rounds; the plan is the same."""
    monkeypatch.setattr(module, "PARTS", parts)
    monkeypatch.setattr(module, "SKETCH", 8 if parts == 4 else 2048)
    rows, p = kinds(400)[name], ScoreParams(k=3, dims=3, buckets=3)
    points = table(spark, rows)
    plan = quantile_plan(points, p, levels=2)
    want = brute(rows, [dim for dim, _ in plan.steps], 3, 3)
    assert {r.id: r.node for r in plan.nodes(points).collect()} == want
    boxes = {r.path: r for r in plan.boxes.collect()}
    assert {path: r.n for path, r in boxes.items()} == dict(collections.Counter(want.values()))
    for i, node in want.items():
        for dim, lo, hi in boxes[node].ranges:
            assert (lo is None or rows[i][dim] > lo) and (hi is None or rows[i][dim] <= hi)


def test_boxes_tile_the_space(spark):
    p = ScoreParams(k=3, dims=3, buckets=3)
    plan = quantile_plan(table(spark, kinds(300)["hot"]), p)
    others = np.random.default_rng(5).normal(0, 1000, (200, 3))
    ranges = [r.ranges for r in plan.boxes.collect()]
    for x in others:
        assert sum(all((lo is None or x[d] > lo) and (hi is None or x[d] <= hi) for d, lo, hi in box) for box in ranges) == 1
    assert {r.node for r in plan.nodes(table(spark, others)).collect()} <= {r.path for r in plan.boxes.collect()}


def test_empty_and_single(spark):
    p = ScoreParams(k=1, dims=2, buckets=4)
    for rows in ([], [(1.0, 2.0)]):
        plan = quantile_plan(table(spark, rows), p)
        assert [tuple(r) for r in plan.boxes.collect()] == [("", len(rows), [])]
    one = quantile_plan(table(spark, kinds(50)["spread"][:, :2]), p.with_(buckets=1))
    assert [r.n for r in one.boxes.collect()] == [50]
    with pytest.raises(ValueError):
        quantile_plan(table(spark, []), p.with_(buckets=1 << 17))


def test_ranks_of_many_values(spark):
    """Several rounds of sketches end at the exact values, some values being a third of all."""
    values = spark.range(200_000).selectExpr("'a' as node", "if(id % 3 = 0, 500.0D, cast((id * 7919) % 200000 as double)) as v")
    ordered = np.sort([r.v for r in values.select("v").collect()])
    ranks = [1, 2, 399, 66_000, 100_000, 199_999, 200_000]
    wanted = spark.createDataFrame([("a", 200_000, ranks)], "node string, n bigint, ranks array<bigint>")
    got = sorted(r.cut for r in selected(values, wanted, 1, len(ranks)).collect())
    assert got == sorted(float(ordered[r - 1]) for r in ranks)


def test_grid_plan_of_more_than_256_buckets(spark):
    p = ScoreParams(k=1, dims=2, cells=1000, buckets=400)
    points = table(spark, np.random.default_rng(4).uniform(0, 100, (3000, 2)))
    plan = partition_plan(points, p)
    sizes = {r.pid: r.n for r in plan.collect()}
    assert len(sizes) > 256 and sum(sizes.values()) == 3000
    found = collections.Counter(r.pid for r in assign_partitions(points, plan, p).collect())
    assert all(found[pid] == n for pid, n in sizes.items())


def test_below_halves(spark):
    rows = [([None, 1.0, 2.5, 2.5, 9.0], v) for v in (0.0, 1.0, 2.0, 2.5, 9.0, 10.0)] + [([], 1.0), ([None], 1.0), ([3.0], 3.0), ([3.0], 4.0)]
    table = spark.createDataFrame(rows, "a array<double>, v double")
    got = [r.n for r in table.selectExpr(f"{module.below('a', 'v', 5)} as n").collect()]
    assert got == [sum(x is None or x < v for x in a) for a, v in rows]


def test_no_row_per_rank_and_slot(spark, monkeypatch):
    """What a level makes grows with its ranks, not with their square."""
    plans, keep_small = [], module.keep_small
    monkeypatch.setattr(module, "keep_small", lambda df, rows: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep_small(df, rows))
    plan = quantile_plan(table(spark, kinds(400)["spread"][:, :2]), ScoreParams(k=3, buckets=5))
    assert plan.boxes.count() == 25
    assert plans and not any("explode(ranks" in x for x in plans)
