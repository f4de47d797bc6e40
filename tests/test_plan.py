import pytest

from outskirt.functions.cells import cell_id, cell_index, cell_indexes
from outskirt.operators.histogram import chi_square, cell_histogram, dimension_order, slab_frequency
from outskirt.operators.knn import searched_leaves
from outskirt.params import ScoreParams
from outskirt.plans.cutter import equi_depth_cut
from outskirt.plans.curve import core_ranges, merged, range_cells, range_points
from outskirt.plans.grid_plan import assign_partitions, partition_plan, partition_sizes, plan_cells


@pytest.mark.parametrize(
    "counts, k, boxes",
    [
        ([5, 0, 3, 2, 0, 4, 1, 0, 2, 3], 1, [(0, 1, 5), (1, 4, 5), (4, 7, 5), (7, 10, 5)]),
        ([6, 6, 6, 0, 0, 0, 0, 0, 0, 2], 3, [(0, 1, 6), (1, 2, 6), (2, 10, 8)]),
        ([6, 20, 2, 2, 2, 2, 2, 2, 1, 1], 1, [(0, 1, 6), (1, 2, 20), (2, 7, 10), (7, 10, 4)]),
        ([0, 0, 9, 0, 0, 0, 0, 0, 0, 0], 1, [(0, 10, 9)]),
    ],
)
def test_cut(spark, counts, k, boxes):
    slabs = spark.createDataFrame([(0, i, n) for i, n in enumerate(counts) if n], "parent int, slab int, n bigint")
    cut = equi_depth_cut(slabs, 4, k, 10).orderBy("bucket").collect()
    assert [(r.lo, r.hi, r.n) for r in cut] == boxes


def test_one_bucket_is_everything(spark):
    slabs = spark.createDataFrame([(7, 3, 5), (7, 4, 5)], "parent int, slab int, n bigint")
    assert [tuple(r) for r in equi_depth_cut(slabs, 1, 1, 10).collect()] == [(7, 0, 0, 10, 10)]


def test_cell_edges(spark):
    p = ScoreParams(cells=50, domain_max=1.0, dims=1)
    v = spark.createDataFrame([(0.0,), (0.58,), (1.0,), (0.9999,)], "v double")
    # 0.58 / 0.02 is just below 29 in binary; index and assignment share one formula
    assert [r[0] for r in v.selectExpr(cell_index("v", p)).collect()] == [0, 28, 49, 49]


def test_cell_id_round_trip_beyond_double(spark):
    cells, dims = 10_000, 4
    ids = spark.createDataFrame([(9_999, 9_998, 3, 9_999), (0, 1, 2, 3)], "a int, b int, c int, d int")
    coded = ids.selectExpr("*", f"{cell_id(['a', 'b', 'c', 'd'], cells)} as cell")
    back = coded.selectExpr("a", "b", "c", "d", "cell", *cell_indexes("cell", dims, cells)).collect()
    for r in back:
        assert tuple(r[:4]) == tuple(r[5:])
    assert {r.cell for r in back} == {9_999 + 9_998 * 10**4 + 3 * 10**8 + 9_999 * 10**12, 1 * 10**4 + 2 * 10**8 + 3 * 10**12}


def _points(spark, n, seed=1, dims=2):
    cols = ", ".join(f"round(pow(rand({seed + i}), 3) * 100, 4)" for i in range(dims))
    return spark.createDataFrame(
        spark.range(1, n + 1).selectExpr("id", f"array({cols}) as c").toArrow()
    )


@pytest.mark.parametrize("dims, buckets, k", [(1, 4, 3), (2, 4, 3), (2, 1, 3), (3, 3, 10)])
def test_plan_tiles_domain(spark, dims, buckets, k):
    p = ScoreParams(k=k, dims=dims, cells=20, buckets=buckets)
    points = _points(spark, 700, dims=dims)
    plan = partition_plan(points, p)
    cells = plan_cells(plan, p)
    assert cells.count() == cells.select("cell_id").distinct().count() == 20**dims
    assigned = assign_partitions(points, plan, p)
    assert assigned.count() == 700
    sizes = {r.pid: r.n for r in partition_sizes(assigned).collect()}
    assert all(sizes.get(r.pid, 0) == r.n for r in plan.collect())
    assert plan.count() <= buckets**dims


def test_uniform_dimension_comes_first(spark):
    p = ScoreParams(cells=10)
    points = spark.createDataFrame([(i, [float(i % 100), 5.0 + i % 3]) for i in range(200)], "id bigint, c array<double>")
    slabs = slab_frequency(cell_histogram(points, p), p)
    stats = {r.dim: r.chi2 for r in chi_square(slabs, p).collect()}
    counts, bins = [20] * 10 + [0], 11
    e = 200 / bins
    assert stats[0] == pytest.approx(sum((f - e) ** 2 / e for f in counts))
    assert dimension_order(slabs, p) == [0, 1]


@pytest.mark.parametrize("leaf_rows", [5, 30])
def test_tree_leaves_are_small_and_complete(spark, leaf_rows):
    p = ScoreParams(k=3, leaf_rows=leaf_rows)
    leaves = searched_leaves(_points(spark, 900), p, 900).table.select("node", "ids").collect()
    assert len({r.node for r in leaves}) == len(leaves) and max(len(r.ids) for r in leaves) <= leaf_rows
    assert sorted(i for r in leaves for i in r.ids) == list(range(1, 901))


def test_plan_of_nothing_is_the_whole_domain(spark):
    p = ScoreParams()
    empty = spark.createDataFrame([], "id bigint, c array<double>")
    assert [tuple(r) for r in partition_plan(empty, p).collect()] == [(0, 0, 50, 0, 50, 0, "00")]


@pytest.mark.parametrize("dims, cells, most", [(1, 20, 4096), (2, 20, 4096), (2, 20, 3), (3, 7, 4096)])
def test_curve_stretches_are_the_boxes(spark, dims, cells, most):
    p = ScoreParams(k=3, dims=dims, cells=cells, buckets=3)
    points = _points(spark, 300, dims=dims)
    plan = spark.createDataFrame(partition_plan(points, p).toArrow())
    ranges = core_ranges(plan, p, most)
    found = sorted(map(tuple, range_cells(merged(ranges), plan, p).collect()))
    assert found == sorted((r.cell_id, r.pid) for r in plan_cells(plan, p).collect())
    assert ranges.where("not whole").isEmpty() == (most > 3)
    assigned = {(r.id, r.pid) for r in assign_partitions(points, plan, p).collect()}
    assert {tuple(r) for r in range_points(points, plan, p).collect()} == assigned and len(assigned) == 300


def test_stretches_follow_the_boxes_not_the_cells(spark):
    p = ScoreParams(cells=1 << 20)
    plan = spark.createDataFrame([(0, 0, 1 << 19, 0, 1 << 20), (1, 1 << 19, 1 << 20, 3, 1 << 20)], "pid int, lo0 int, hi0 int, lo1 int, hi1 int")
    n = {r.pid: r.n for r in core_ranges(plan, p, 64).groupBy("pid").agg({"*": "count"}).toDF("pid", "n").collect()}
    assert n[0] <= 2 and n[1] < 64 * 41
