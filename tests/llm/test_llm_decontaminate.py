import pathlib
import random
import re
import subprocess
import sys

import cases
import pytest
from outskirt.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(item, doc, least):
    """Greedy string tiling as published: mark the longest common unmarked run, again and again."""
    used_item, used_doc = [False] * len(item), [False] * len(doc)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                    if used_item[i + n] or used_doc[j + n]:
                        break
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sum(used_item)
        for x in range(n):
            used_item[i + x] = used_doc[j + x] = True


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
def test_tiles_equal_the_published_method(letters):
    rng = random.Random(4)
    for _ in range(60):
        item, doc = (rng.choices(letters, k=rng.randint(0, n)) for n in (20, 35))
        found = dc.tiles(dc.text_words(" ".join(item)), dc.text_words(" ".join(doc)), 3)
        assert sum(n for _, _, n in found) == brute(item, doc, 3)
        assert all(item[i : i + n] == doc[j : j + n] for i, j, n in found)


def test_whole_corpus_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(k, " ".join(f"t{rng.randrange(400)}" for _ in range(rng.randint(0, 40)))) for k in range(12)]
    items += [(50, None), (51, "too short"), (None, items[3][1]), (52, items[3][1])]
    words = items[3][1].split()
    half = len(words) // 2
    docs = cases.texts() + [
        (200, f"before {items[3][1].upper()}, after"),
        (201, " ".join(words[half:] + ["and", "then"] + words[:half])),  # reordered
        (202, " ".join(words[: half // 2])),
        (203, None), (204, " ".join(words)), (204, " ".join(words)),
        (None, " ".join(words)),
    ]
    docs += [(300 + i, " ".join(f"t{rng.randrange(400)}" for _ in range(50))) for i in range(20)]
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    found = dc.contaminated(cases.table(spark, docs), bench)
    got = {(r.doc_id, r.item_id, r.covered, r.item_words) for r in found.collect()}
    want = set()
    split = lambda t: WORD.findall((t or "").lower())
    for k, t in items:
        for i, d in docs:
            covered = brute(split(t), split(d), 5) if k is not None and set(split(t)) & set(split(d)) else 0
            if covered and covered >= 0.5 * len(split(t)):
                want.add((i, k, covered, len(split(t))))
    assert got == want and {200, 201, 204, None} <= {i for i, *_ in got}
    kept = dc.drop_contaminated(cases.table(spark, docs), bench)
    bad = {i for i, *_ in got}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in bad or i is None and _ != docs[-21][1]), key=repr)
    assert kept.columns == cases.table(spark, []).columns


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(dc, "FILTER_BITS", 64)
    text = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    found = dc.contaminated(cases.table(spark, cases.texts() + [(9, text)]), bench).collect()
    assert [(r.doc_id, r.coverage) for r in found] == [(9, 1.0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert dc.contaminated(cases.table(spark), none).count() == 0
    assert dc.contaminated(cases.table(spark, []), some).count() == 0
    assert dc.drop_contaminated(cases.table(spark), none).count() == len(cases.texts())


def test_texts_of_one_id_and_null_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 20), ("b", 200), ("c", 30))]
    items = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (None, texts[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = cases.table(spark, [*cases.texts(), (900, f"x {texts[0]} y"), (901, texts[1]), (902, texts[2])])
    found = dc.contaminated(docs, bench, unnamed=True).collect()
    want = {(900, 1, 20, 1.0), (901, 1, 200, 1.0), (902, None, 30, 1.0)}
    assert len(found) == 3 and {(r.doc_id, r.item_id, r.item_words, r.coverage) for r in found} == want
    kept = {r.doc_id for r in dc.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, _ in cases.texts()}


def test_rounds_mark_the_same_tiles(monkeypatch):
    rng = random.Random(8)
    for _ in range(60):
        letters = rng.choice(["a", "ab", "abc"])
        item, doc = (rng.choices(letters, k=rng.randint(0, n)) for n in (60, 90))
        item, doc = dc.text_words(" ".join(item)), dc.text_words(" ".join(doc))
        monkeypatch.setattr(dc, "SEED_PAIRS", 1 << 20)
        at_once = dc.tiles(item, doc, 3)
        monkeypatch.setattr(dc, "SEED_PAIRS", 7)
        assert dc.tiles(item, doc, 3) == at_once


def test_repetitive_texts_stay_in_memory():
    code = """
import resource, sys
from outskirt.llm import decontaminate as dc
for unit, n, m in (("a ", 10_000, 200_000), ("a b c ", 3_000, 60_000), ("a " * 50 + "b ", 100, 2_000)):
    item, doc = dc.text_words(unit * n + "x"), dc.text_words("y " + unit * m)
    assert sum(k for _, _, k in dc.tiles(item, doc, 5)) == len(item) - 1
assert dc.tiles(dc.text_words("a " * 3_000), dc.text_words(("a " * 70 + "b ") * 500), 5)[0][2] == 70
resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20 or sys.exit("over 1 GB")
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=pathlib.Path(__file__).parents[2])
