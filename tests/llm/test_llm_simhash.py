import random

import cases
import numpy as np
import pytest
import xxhash
from outskirt.llm import simhash
from outskirt.llm.components import components
from outskirt.llm.shared import shared_folder


def fingerprint(text):
    words = cases.WORDS.findall((text or "").translate(cases.ABC))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_equals_brute_force(spark):
    rows = cases.texts()
    fps = [fingerprint(t) for _, t in rows]
    near = cases.components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[near[f]] = min(i, least.get(near[f], i))
    want = sorted(((i, f"{f:016x}", least.get(near[f])) for (i, _), f in zip(rows, fps, strict=True)), key=repr)
    found = simhash.near_duplicates(cases.table(spark)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == want
    kept = simhash.drop_near_duplicates(cases.table(spark))
    assert kept.columns == cases.table(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(near.values())) and {i for i in least.values()} <= set(ids)


@pytest.mark.parametrize("block, small", [(1024, 24), (8, 4)])
def test_links_lose_nothing(spark, monkeypatch, block, small):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(3)
    nodes = set()
    for _ in range(6):  # clouds around six centres, and strangers
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            nodes.add(f)
    nodes |= {rng.getrandbits(64) for _ in range(100)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = cases.components(sorted(map(signed, nodes)), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4)
    folder = shared_folder(spark)
    found = simhash.links(spark.createDataFrame([(signed(f),) for f in nodes], "fp long"), folder)
    stars = {r.a: r.b for r in components(found, folder).collect()}
    assert {n: stars.get(n, n) for n in want} == want


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.table(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(cases.table(spark, [])).count() == 0


def test_manhattan_is_a_lower_bound():
    x, y = (np.random.default_rng(s).integers(0, 2**63, 5000, dtype=np.uint64) for s in (1, 2))
    y[::2] = x[::2] ^ np.uint64(0b1011)
    bound = np.bitwise_count(simhash.grid_points(x) ^ simhash.grid_points(y))
    assert (bound <= np.bitwise_count(x ^ y)).all()
    assert np.array_equal(simhash.near(x, y), np.bitwise_count(x ^ y) <= 4)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    found = components(edges, shared_folder(spark)).collect()
    assert sorted((r.a, r.b) for r in found) == [(i, 0) for i in range(1, 101)]
