import random
from collections import defaultdict
from hashlib import sha256

import cases
from outskirt.llm import merkle
from pyspark.sql import functions as F


def digest(*values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return sha256("".join(parts).encode()).hexdigest()


def joined(digests):
    return sha256("".join(digests).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([joined(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        r = at // 8 * 8
        out.append((level[r:at], level[at + 1 : r + 8]))
        at //= 8
    return out


def brute(rows, given):
    """rows (group, order, leaf) and the digests given instead: (order, leaf, subroot, root, proof, folded root), sorted."""
    groups = defaultdict(list)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][1] is not None, rows[i][1] or 0, rows[i][2])):
        groups[rows[i][0]].append(i)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([rows[i][2] for i in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for at, i in enumerate(groups[g]):
            path = siblings(trees[g], at) + siblings(top, place)
            folded = given[i]
            for before, after in path:
                folded = joined([*before, folded, *after])
            proof = "".join(x for b, a in path for x in (*b, *a))
            out.append((rows[i][1], rows[i][2], trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows, tampered):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, digest string")
    leaf = merkle.row_digest([F.col("doc_id"), F.col("text"), F.col("lang")])
    given = F.when(F.col("doc_id") % 3 == tampered, merkle.row_digest([F.col("doc_id"), F.upper("text"), F.col("lang")])).otherwise(leaf)
    got = sorted(map(tuple, merkle.proofs(docs, leaf, given, "lang", "doc_id").collect()), key=repr)
    leaves = [(g, i, digest(i, t, g)) for i, t, g in rows]
    changed = [
        digest(i, None if t is None else t.upper(), g) if i is not None and i % 3 == tampered else leaf
        for (i, t, g), (_, _, leaf) in zip(rows, leaves)
    ]
    assert got == brute(leaves, changed)
    return got


def test_equals_brute_force(spark, monkeypatch):
    # Small chunks and sets, so that several rounds and ranges take part.
    monkeypatch.setattr(merkle, "STEP", 1)
    monkeypatch.setattr(merkle, "CHUNK", 8)
    monkeypatch.setattr(merkle, "SET_ROWS", 11)
    rng = random.Random(2)
    rows = [(i, rng.choice(["A b", "ABC", "x", "é", "", None]), rng.choice(["en"] * 8 + ["é", "z", None])) for i in range(700)]
    rows += [(1000, "one", "lone"), (None, "t", "en"), (None, None, None), (5, "A b", "en"), (5, "A b", "en")]
    got = check(spark, rows, 1)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_small_tables(spark):
    for n in (0, 1, 8, 9):
        check(spark, [(i, "Text", "en") for i in range(n)], 0)
    check(spark, [(1, None, None)], 2)


def test_field_boundaries_count(spark):
    rows = spark.createDataFrame([("a", "b"), ("ab", ""), ("a1:b", None), (None, "1:b")], "x string, y string")
    assert rows.select(merkle.row_digest([F.col("x"), F.col("y")]).alias("d")).distinct().count() == 4


def test_missing_is_least():
    # Leaves 0 to 9 of 20: the second run misses 10 to 15, the third run's node and no other.
    assert merkle.missing(list(range(10)), 20) == [(0, at) for at in range(10, 16)] + [(1, 2)]
    assert merkle.missing([3], 1) == []


def test_repeated_row_and_clashing_columns(spark):
    docs = cases.table(spark, [(1, "same")] * 3000 + [(2, "other")])
    leaf = merkle.row_digest([F.col("doc_id"), F.col("text")])
    out = merkle.proofs(docs, leaf, leaf, "lang", "doc_id")
    assert out.count() == 3001 and out.where("verified").count() == 3001
