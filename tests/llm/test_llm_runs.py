import random
import re
import zlib

import cases
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from outskirt.llm import queries, runs
from pyspark.sql import functions as F


def brute(x):
    """(start, length, period) of all runs, comparing all pairs of words up to a quarter of the text apart."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted([s, n, q] for (s, n), q in found.items())


def collapsed(x, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(x) if i not in gone)


def periodic(rng):
    x = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 3)):
        if len(x) > 8:
            a, p = rng.randrange(len(x)), rng.randint(1, len(x) // 5 + 1)
            for i in range(a + p, min(len(x), a + rng.randint(1, len(x)))):
                x[i] = x[i - p]
    return [str(w) for w in x]


def work(texts):
    return runs._work([[w.encode() for w in x] for x in texts])


def test_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        texts = [periodic(rng) for _ in range(rng.randint(1, 6))]
        found, kept = work(texts)
        assert found == [brute(x) for x in texts]
        assert [k.decode() for k in kept] == [collapsed(x, f) for x, f in zip(texts, found)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=3))
def test_two_words(texts):
    assert work(texts)[0] == [brute(x) for x in texts]


def test_long_texts():
    n = 200_000
    for unit in (["a"], ["a", "b"], [str(i) for i in range(977)]):
        assert work([(unit * (n // len(unit) + 1))[:n]])[0] == [[[0, n, len(unit)]]]
    thue = [str(bin(i).count("1") % 2) for i in range(n)]
    assert work([thue])[0] == [[]]


def test_grammar_derives_the_text():
    ids = np.array([int(x) for x in "121212312123121231" * 9])
    nodes, rules, places, at = runs.repair(ids)
    assert len(at) - 1 < len(ids) / 9
    for rule, (lo, _, hi) in enumerate(nodes.T):
        own = places[rules == rule]
        assert len(own) > 1
        for place in own:
            assert (ids[place : place + hi - lo] == ids[lo:hi]).all()


def test_odd_texts(spark):
    rows = [*cases.texts(), (80, "x " * 6), (81, "x " * 5), (82, "a b " * 4 + "c"), (83, "a b c " * 7)]
    out = runs.collapse_runs(cases.table(spark, rows).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x")))
    assert set(cases.CLASHING) <= set(out.columns)
    got = [(r.doc_id, r.n_words, [list(x) for x in r.runs], r.text) for r in out.collect()]
    want = []
    for i, t in rows:
        x = cases.WORDS.findall(t or "")
        want.append((i, len(x), brute(x) if len(x) < 1000 else [], collapsed(x, brute(x)) if len(x) < 1000 else " ".join(x)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert runs.collapse_runs(cases.table(spark, [])).count() == 0


def test_best_run_and_edit(spark):
    pairs = spark.createDataFrame([([(0, 8, 2), (20, 12, 3), (40, 4, 1)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [tuple(r.b) if r.b else None for r in pairs.select(runs.best_run(F.col("runs")).alias("b")).collect()] == [(0, 8, 2), None]
    rows = [(i, " ".join(str(j) for j in range(i % 37))) for i in range(400)] + [(None, "a b"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.t for r in docs.select("doc_id", queries.repeat_words(F.col("text"), F.col("doc_id")).alias("t")).collect() if r.doc_id != 7}
    edited = 0
    for i, t in rows[:-1]:
        h, x = zlib.crc32(str(i).encode()), re.findall(r"\S+", t)
        n, g = len(x), h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(x[j] if j < a else x[a + (j - a) % p] for j in range(n))
            edited += 1
        if i != 7:
            assert got[i].split() == t.split()
    assert edited > 20
