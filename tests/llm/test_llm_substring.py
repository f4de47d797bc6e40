import random
from collections import Counter

import cases
import numpy as np
import pytest
from outskirt.llm import substring
from outskirt.llm.tokens import Spans, word_hashes


def brute(rows, window):
    split = [(i, cases.WORDS.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[a : a + window]) for _, w in split for a in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone.update(range(a, a + window))
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    out = substring.remove_repeated_spans(cases.table(spark))
    assert got(out) == brute(cases.texts(), 35)
    assert out.columns[: 5 + len(cases.CLASHING)] == cases.table(spark).columns


@pytest.mark.parametrize("window, seed", [(6, 3), (5, 1), (8, 8)])
def test_small_alphabet(spark, window, seed):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 40)))) for i in range(40)]
    rows += [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 60)))) for i in range(40, 80)]
    out = substring.remove_repeated_spans(cases.table(spark, rows), window, seed)
    assert got(out) == brute(rows, window)


def test_empty_table(spark):
    assert substring.remove_repeated_spans(cases.table(spark, [])).count() == 0


def test_pieces_partition_the_windows():
    words = word_hashes(" ".join(random.Random(2).choices("abcd", k=500)).encode())
    first, n, _, _ = substring.pieces(words, 35, 10)
    assert np.array_equal(first, np.cumsum(np.concatenate(([0], n[:-1])))) and n.sum() == 500 - 34


def test_hashes_depend_on_the_words_only():
    a, b = Spans(word_hashes(b"x y z x y z")), Spans(word_hashes("x\ty  z\n x y z".encode()))
    assert a.grams(3)[0] == a.grams(3)[3] == b.grams(3)[0]
    assert len(set(a.grams(3)[:3].tolist())) == 3
