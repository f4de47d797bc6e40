"""Files in byte ranges, random samples without a global order, slabs of expanded boxes."""

import itertools
import random

import numpy as np
import pytest

from outskirt import ScoreParams
from outskirt.operators import points, support
from outskirt.sources import ranges
from outskirt.sources.shapefile import read_shapes
from outskirt.sources.tables import load_npy


def test_a_large_array_takes_several_tasks(spark, tmp_path):
    rows = np.arange(200 * 2**20 // 8, dtype=np.float64).reshape(-1, 4)
    np.save(tmp_path / "large.npy", rows)
    scan = ranges.scan(spark, ranges.NpySource, str(tmp_path))
    assert scan.rdd.getNumPartitions() == 7
    got = scan.selectExpr("count(1)", "sum(c[0])", "max(c[3])").first()
    assert tuple(got) == (len(rows), rows[:, 0].sum(), rows[-1, 3])


def test_arrays_of_all_kinds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_BYTES", 64)
    (tmp_path / "below").mkdir()
    made = {
        "a.npy": np.arange(60, dtype=np.int32).reshape(20, 3),
        "b.npy": np.asfortranarray(np.arange(60, 90, dtype=">f4").reshape(10, 3)),
        "below/c.npy": np.array([1.0, 2.0, 3.0]),
        "d.npy": np.zeros((0, 3)),
    }
    for name, array in made.items():
        np.save(tmp_path / name, array)
    (tmp_path / "notes.txt").write_text("no array")
    got = load_npy(spark, f"file://{tmp_path}").orderBy("id").collect()
    want = np.concatenate([made["a.npy"], made["b.npy"], made["below/c.npy"][None]]).astype(float)
    assert [list(r.c) for r in got] == want.tolist() and [r.id for r in got] == list(range(1, 32))
    np.save(tmp_path / "e.npy", np.array(["x", None], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="array of objects"):
        load_npy(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("index", [True, False])
def test_shapes_are_read_by_index(spark, tmp_path, monkeypatch, index):
    monkeypatch.setattr(ranges, "RANGE_BYTES", 200)
    parts = ranges.shape_files([(1, np.array([i, -i], dtype="<f8").tobytes()) for i in range(50)])
    ranges.write_files(str(tmp_path / "layer"), "points", parts if index else {".shp": parts[".shp"]})
    shapes = read_shapes(spark, str(tmp_path))
    assert (shapes.rdd.getNumPartitions() > 5) == index
    got = sorted((r.record, r.layer, r.type, r.parts[0][0]) for r in shapes.collect())
    assert got == [(i + 1, "layer", "Point", [float(i), float(-i)]) for i in range(50)]


def test_no_files(spark, tmp_path):
    assert load_npy(spark, str(tmp_path)).count() == 0 and read_shapes(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("most", [5, 20_000])
def test_random_sample_is_the_smallest_hashes(spark, monkeypatch, most):
    import hashlib

    monkeypatch.setattr(points, "_ORDERED_ROWS", most)
    ids = list(range(3000)) + [7] * 3
    df = spark.createDataFrame([(i, float(i)) for i in ids], "id bigint, x double").repartition(7)
    order = sorted(ids, key=lambda i: (int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:15], 16), i))
    for n in (1, 100, 2999):
        got = points.sample_random(df, n)
        assert sorted(r.id for r in got.collect()) == sorted(order[:n])
    assert points.sample_random(df, 4000).count() == len(ids)
    assert points.sample_random(df.where("false"), 10).count() == 0


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_slabs_are_the_cells_of_the_expanded_box(spark, dims):
    rng, p = random.Random(dims), ScoreParams(dims=dims, cells=12, domain_max=24.0)
    rows, want = [], {}
    for pid in range(12):
        lo = [rng.randint(0, 8) for _ in range(dims)]
        hi = [rng.randint(a + 1, 12) for a in lo]
        ex = [rng.choice([0.0, 0.5, 2.0, 5.25]) for _ in range(2 * dims)]
        rows.append((pid, *(v for d in range(dims) for v in (lo[d], hi[d])), *ex))
        sides = []
        for d in range(dims):
            first, last = max(0, int((lo[d] * 2 - ex[2 * d]) // 2)), min(12, -int(-(hi[d] * 2 + ex[2 * d + 1]) // 2))
            sides.append(range(first, last))
        core = [range(a, b) for a, b in zip(lo, hi)]
        want[pid] = {c for c in itertools.product(*sides) if not all(i in s for i, s in zip(c, core))}
    names = [f"{e}lo{d} {t}, {e}hi{d} {t}" for e, t in (("", "int"), ("ex_", "double")) for d in range(dims)]
    slabs = support.support_slabs(spark.createDataFrame(rows, f"pid int, {', '.join(names)}"), p).collect()
    got: dict[int, list] = {pid: [] for pid in want}
    for s in slabs:
        got[s.pid] += itertools.product(*(range(s[f"lo{d}"], s[f"hi{d}"]) for d in range(dims)))
    assert all(len(cells) == len(set(cells)) and set(cells) == want[pid] for pid, cells in got.items())
    assert len(slabs) <= 2 * dims * len(rows)
