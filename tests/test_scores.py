import random

import pytest
from brute import brute_force

from outskirt import ScoreParams, score_points, score_table
from outskirt.functions.neighbors import edges
from outskirt.job import score_files
from outskirt.operators import joins
from outskirt.operators.knn import exact_knn
from outskirt.operators.score import force_vectors, net_force, net_force_of
from outskirt.operators.support import ball_status, local_neighbors
from outskirt.plans.grid_plan import partition_plan

SEVEN = [(1, [10.0, 10.0]), (2, [13.0, 14.0]), (3, [10.0, 20.0]), (4, [50.0, 50.0]), (5, [53.0, 54.0]), (6, [90.0, 10.0]), (7, [10.0, 10.0])]


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, c array<double>")


def check(spark, rows, p, lists=False):
    points = table(spark, rows)
    want = brute_force([r[0] for r in rows], [r[1] for r in rows], p)
    scores = {r.id: (r.kdist, r.lcf, r.nof) for r in score_points(points, p).collect()}
    assert scores == {i: w[2:] for i, w in want.items()}
    if not lists:
        return
    knn = {r.id: (list(r.nid), list(r.nd)) for r in exact_knn(points, p).collect()}
    assert knn == {i: (w[0], w[1]) for i, w in want.items()}


@pytest.mark.parametrize("leaf_rows", [4, 100])
def test_seven_points(spark, leaf_rows):
    p = ScoreParams(k=2, leaf_rows=leaf_rows)
    got = {r.id: (r.kdist, r.lcf, r.nof) for r in score_points(table(spark, SEVEN), p).collect()}
    assert got == {
        1: (5.0, 125.0, 187.5),
        2: (5.0, 250.0, 125.0),
        3: (10.0, 1277.31, 187.5),
        4: (50.0, 124880.0, 83069.32),
        5: (54.82, 164861.33, 63078.655),
        6: (57.49, 370691.58, 144870.665),
        7: (5.0, 125.0, 187.5),
    }


def test_forces_of_seven_points(spark):
    p = ScoreParams(k=2)
    vectors = force_vectors(exact_knn(table(spark, SEVEN), p), p)
    by_pair = {(r.id, r.nid): (r.f0, r.f1) for r in vectors.collect()}
    assert by_pair[3, 2] == (-135.0723, 270.1446)
    assert by_pair[3, 1] == (0.0, 1000.0)
    assert by_pair[4, 3] == (100000.0, 75000.0)
    row_wise = {r.id: (r.kdist, r.lcf) for r in net_force(exact_knn(table(spark, SEVEN), p), p).collect()}
    assert row_wise == {r.id: (r.kdist, r.lcf) for r in net_force_of(vectors, p).collect()}


def skewed(n, dims, seed, spots=0.34):
    """A third of all rows at one location, a dense clump, the rest spread thinly."""
    rng, rows = random.Random(seed), []
    for i in rng.sample(range(10 * n), n):
        u = rng.random()
        if u < spots:
            c = [25.0] * dims
        elif u < 0.7:
            c = [round(25.5 + rng.random() / 50, 4) for _ in range(dims)]
        else:
            c = [round(rng.random() * 100, 4) for _ in range(dims)]
        rows.append((i, c))
    return rows


@pytest.mark.parametrize(
    "dims, k, leaf_rows, metric",
    [(1, 3, 6, "l2"), (2, 3, 8, "l2"), (2, 5, 64, "l1"), (3, 2, 20, "l2"), (5, 3, 40, "l2"), (20, 3, 60, "l2")],
)
def test_equals_brute_force_on_skewed_points(spark, dims, k, leaf_rows, metric):
    check(spark, skewed(600, dims, dims), ScoreParams(k=k, dims=dims, leaf_rows=leaf_rows, metric=metric))


def test_equals_brute_force_without_rounding(spark):
    p = ScoreParams(k=3, leaf_rows=16, point_scale=None, dist_scale=None, force_scale=None, lcf_scale=None, nof_scale=None)
    rows = skewed(400, 2, 9)
    want = brute_force([r[0] for r in rows], [r[1] for r in rows], p)
    for r in score_points(table(spark, rows), p).collect():
        assert (r.kdist, r.lcf, r.nof) == pytest.approx(want[r.id][2:], rel=1e-12)


def test_sparse_points_beside_a_dense_clump(spark):
    rng = random.Random(3)
    rows = [(i, [round(50 + rng.random(), 4), round(rng.random(), 4)]) for i in range(500)]
    rows += [(1000 + i, [round(rng.random() * 45, 4), round(rng.random() * 100, 4)]) for i in range(12)]
    check(spark, rows, ScoreParams(k=4, leaf_rows=8), lists=True)


def test_large_and_skewed_lookup_path(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    check(spark, skewed(500, 2, 4), ScoreParams(k=3, leaf_rows=30), lists=True)


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_few_rows(spark, n):
    rows = [(i, [float(i * i), 1.0]) for i in range(n)]
    check(spark, rows, ScoreParams(k=3))


def test_all_rows_equal(spark):
    rows = [(i, [3.0, 3.0]) for i in range(50)]
    p = ScoreParams(k=3, leaf_rows=5)
    got = score_points(table(spark, rows), p).collect()
    assert len(got) == 50 and {(r.kdist, r.lcf, r.nof) for r in got} == {(0.0, 0.0, 0.0)}


def test_scores_do_not_depend_on_the_layout(spark):
    rows = skewed(300, 2, 5)
    got = []
    for leaf_rows, cells, buckets, parts in [(8, 50, 4, 1), (20, 7, 2, 5), (400, 30, 3, 3)]:
        p = ScoreParams(k=3, leaf_rows=leaf_rows, cells=cells, buckets=buckets)
        points = table(spark, sorted(rows, key=lambda r: r[0] * parts % 17)).repartition(parts)
        got.append({tuple(r) for r in score_points(points, p).select("id", "kdist", "lcf", "nof").collect()})
    assert got[0] == got[1] == got[2]


def test_kdist_grows_with_k(spark):
    points = table(spark, skewed(200, 2, 6))
    kdist = [
        {r.id: r.nd[-1] for r in exact_knn(points, ScoreParams(k=k, leaf_rows=20)).collect()} for k in (1, 3, 6)
    ]
    assert all(kdist[0][i] <= kdist[1][i] <= kdist[2][i] for i in kdist[0])


def test_settled_points_need_no_other_partition(spark):
    p = ScoreParams(k=3, cells=20)
    points = table(spark, skewed(600, 2, 7, spots=0.05))
    plan = spark.createDataFrame(partition_plan(points, p).toArrow())
    local = local_neighbors(points, plan, p)
    best = {r.id: list(r.nid) for r in exact_knn(points, p).collect()}
    status = ball_status(local, plan, p).collect()
    assert {r.status for r in status} == {"T", "F"}
    assert all(list(r.nid) == best[r.id] for r in status if r.status == "T")
    assert any(list(r.nid) != best[r.id] for r in status if r.status == "F")


def test_score_table(spark):
    df = spark.createDataFrame([(i, float(i % 7), 5.0, "label") for i in range(30)], "id long, a double, b double, l string")
    got = score_table(df, ScoreParams(k=2)).collect()
    assert len(got) == 30 and {r.c[1] for r in got} == {0.0}
    assert max(r.c[0] for r in got) == 100.0


def test_edges_rank_from_one(spark):
    knn = exact_knn(table(spark, SEVEN), ScoreParams(k=2))
    assert {r["rank"] for r in edges(knn, 2).collect()} == {1, 2}


@pytest.mark.parametrize("detail", [False, True])
def test_score_files(spark, tmp_path, detail):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = skewed(120, 2, 8)
    table(spark, rows).selectExpr("id", "c[0] as x", "c[1] as y", "'a' as label").write.parquet(source)
    # no id is a multiple of the denominator: the sample is empty, the plan one box
    p = ScoreParams(k=3, denominator=1_000_003, leaf_rows=20)
    score_files(spark, source, target, p, detail)
    want = brute_force([r[0] for r in rows], [r[1] for r in rows], p)
    got = {r.id: (r.kdist, r.lcf, r.nof) for r in spark.read.parquet(target).collect()}
    assert got == {i: w[2:] for i, w in want.items()}


def test_domain_below_zero(spark):
    rows = [(i, [round(v - 50.0, 4) for v in c]) for i, c in skewed(300, 2, 11)]
    p = ScoreParams(k=3, leaf_rows=30, domain_min=-50.0, domain_max=50.0, cells=20)
    check(spark, rows, p)
    points = table(spark, rows)
    plan = spark.createDataFrame(partition_plan(points, p).toArrow())
    best = {r.id: list(r.nid) for r in exact_knn(points, p).collect()}
    status = ball_status(local_neighbors(points, plan, p), plan, p).collect()
    assert len(status) == 300
    assert all(list(r.nid) == best[r.id] for r in status if r.status == "T")


@pytest.mark.parametrize("dims, cells, buckets", [(1, 7, 2), (2, 50, 4), (2, 1100, 65), (4, 50, 4)])
def test_every_row_stays_whatever_the_grid(spark, dims, cells, buckets):
    """Points outside the domain are neighbours like others; plan settings change nothing."""
    rows = skewed(150, dims, 20 + dims) + [(100_000 + i, [-300.0 + i] * dims) for i in range(3)]
    rows += [(200_000, [5000.0] * dims), (200_001, [150.0] + [5.0] * (dims - 1))]
    check(spark, rows, ScoreParams(k=3, dims=dims, leaf_rows=20, cells=cells, buckets=buckets))


@pytest.mark.parametrize("cells, buckets, dims", [(20, 65, 2), (6, 3, 4)])
def test_result_rows_take_any_plan(spark, cells, buckets, dims):
    from outskirt.job import result_rows

    rows = skewed(120, dims, 31)
    p = ScoreParams(k=3, dims=dims, leaf_rows=20, cells=cells, buckets=buckets)
    want = brute_force([r[0] for r in rows], [r[1] for r in rows], p)
    got = {r.id: (r.kdist, r.lcf, r.nof) for r in result_rows(table(spark, rows), p).collect()}
    assert got == {i: w[2:] for i, w in want.items()}


@pytest.mark.parametrize("k", [1, 2])
def test_far_outliers_have_exact_forces(spark, k):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [999_999.0, 999_999.0])]
    p = ScoreParams(k=k, domain_max=1e6)
    assert p.wide and not ScoreParams().wide
    want = brute_force([r[0] for r in rows], [r[1] for r in rows], p)
    for r in score_points(table(spark, rows), p).collect():
        assert (r.kdist, r.lcf, r.nof) == pytest.approx(want[r.id][2:], rel=1e-12)
    assert want[4][3] > 2.8e18


def test_many_neighbours_on_a_large_domain(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() * 10_001, rng.random() * 10_001]) for i in range(700)]
    p = ScoreParams(k=500, domain_max=10_001.0)
    want = brute_force([r[0] for r in rows], [r[1] for r in rows], p)
    for r in score_points(table(spark, rows), p).collect():
        assert (r.kdist, r.lcf, r.nof) == pytest.approx(want[r.id][2:], rel=1e-9)
