import random

import cases
import corpus_pipeline
import numpy as np
import pytest
import xxhash
from outskirt.llm import nearcopies


def grams(text):
    words = cases.WORDS.findall((text or "").translate(cases.ABC))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def edited():
    """Copies with 0 to 8 changed words of a text, long and short, others around a shared passage."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, passage = [], [word() for _ in range(60)]
    for size in (12, 40, 200, 200):
        base = [word() for _ in range(size)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randint(0, max(2, size // 25))):
                text[rng.randrange(size)] = word()
            rows.append(" ".join(text))
    rows += [" ".join([*(word() for _ in range(25)), *passage, *(word() for _ in range(25))]) for _ in range(12)]
    return list(enumerate(rows, 1000))


@pytest.mark.parametrize("block, small", [(1024, 8), (8, 2)])
def test_stage_equals_brute_force_jaccard(spark, monkeypatch, block, small):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "SMALL", small)
    rows = cases.texts() + edited()
    sets = [grams(t) for _, t in rows]
    near = cases.components(list(range(len(rows))), lambda a, b: alike(sets[a], sets[b]))
    best = {}
    for k, (i, _) in enumerate(rows):
        best[near[k]] = min(best.get(near[k], (True, 0)), (i is None, i or 0))
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, cases.table(spark, rows), "")
    assert out.columns == cases.table(spark, []).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted(best.values())
    assert 12 < len([k for k in set(near.values()) if k >= len(cases.texts())]) < 60


def fingerprint(text):
    words = cases.WORDS.findall((text or "").translate(cases.ABC))
    shingles = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def met(f, g):
    """At most 14 bits differ, and of eight blocks of four two-bit segments at least four have the same bit counts."""
    counts = lambda x, b: [(x >> 8 * b + s & 3).bit_count() for s in (0, 2, 4, 6)]
    return (f ^ g).bit_count() <= 14 and sum(counts(f, b) == counts(g, b) for b in range(8)) >= 4


def close():
    """Copies with 0 to 4 changed words of three texts of 400 words."""
    rng, rows = random.Random(4), []
    for k in range(3):
        base = [f"c{k}w{rng.randrange(10**6)}" for _ in range(400)]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(400)] = f"w{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    return list(enumerate(rows, 2000))


def test_simhash_finds_links_and_the_exact_join_the_rest(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/made"
    monkeypatch.setattr(nearcopies, "shared_folder", lambda _: folder)
    nearcopies.drop_near_copies(cases.table(spark, cases.texts() + edited() + close())).count()
    read = lambda name: spark.read.parquet(f"{folder}/{name}").collect()
    text = {r["__row"]: r["text"] for r in read("texts_*")}
    sets, first, least = {i: grams(t) for i, t in text.items()}, {}, {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    prints = {i: fingerprint(text[i]) for i in first.values()}
    for i in sorted(prints):
        least.setdefault(prints[i], i)
    want = {(least[f], i) for i, f in prints.items() if i != least[f]}
    want |= {(a, b) for f, a in least.items() for g, b in least.items() if a < b and met(f, g)}
    want = {(a, b) for a, b in want if alike(sets[a], sets[b])}
    assert {(r.a, r.b) for r in read("links_simhash")} == want and len(want) > 20
    label = {r.a: r.b for r in read("stars_simhash")}
    left = [(r.a, r.b) for r in read("allowed")]
    assert left and not [p for p in left if label.get(p[0], p[0]) == label.get(p[1], p[1])]


def test_empty_table(spark):
    assert nearcopies.drop_near_copies(cases.table(spark, [])).count() == 0


def phrased(n):
    """Short texts of a few fixed phrases and a word of their own: crowded cells, in which many are near copies."""
    rng = random.Random(5)
    phrases = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(8)]
    return [(i, " ".join([*rng.sample(phrases, 3), f"own{i}"])) for i in range(n)]


def test_pairs_grow_no_faster_than_rows(spark, tmp_path, monkeypatch):
    folders = iter(f"file://{tmp_path}/{n}" for n in (300, 1200))
    monkeypatch.setattr(nearcopies, "shared_folder", lambda _: next(folders))
    pairs = []
    for n in (300, 1200):
        rows = phrased(n)
        out = {r.doc_id for r in nearcopies.drop_near_copies(cases.table(spark, rows)).collect()}
        sets = [grams(t) for _, t in rows]
        near = cases.components(list(range(n)), lambda a, b: alike(sets[a], sets[b]))
        assert out == set(near.values()) and 1 < len(out) < n / 2
        pairs.append(sum(spark.read.parquet(f"file://{tmp_path}/{n}/{name}").count() for name in ("allowed", "pairs_across")))
    assert 0 < pairs[1] < 6 * pairs[0]


def test_sketches_allow_all_that_are_alike():
    rng = random.Random(3)
    for n in (1, 7, 65, 700, 4000):
        for _ in range(20):
            x = np.array(sorted({rng.getrandbits(64) for _ in range(n)}), dtype=np.uint64)
            keep = rng.randint(n * 4 // 5, n)
            y = np.concatenate((x[:keep], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, n // 5))], dtype=np.uint64)))
            y = np.unique(y)
            can = nearcopies.may_be_alike(nearcopies.sketch(x), nearcopies.sketch(y)[None], len(x), np.array([len(y)]))[0]
            assert can or not nearcopies.alike(x, y)
    full = np.arange(0, 64 * 400, 64, dtype=np.uint64)
    assert nearcopies.may_be_alike(nearcopies.sketch(full), nearcopies.sketch(full[:390])[None], 400, np.array([390]))[0]
