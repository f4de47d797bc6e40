import hashlib
from collections import Counter

import cases
import numpy as np
from outskirt.llm import fingerprints


def jaccard(a, b):
    a, b = (Counter(cases.WORDS.findall(t)) for t in (a, b))
    every = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in every) / sum(max(a[w], b[w]) for w in every) if every else 1.0


def test_edits_and_likeness(spark):
    rows = [(i, t or "") for i, t in dict((i, t) for i, t in cases.texts() if i is not None).items()]
    rows.sort(reverse=True)
    out = {r.doc_id: r for r in fingerprints.fingerprints(cases.table(spark, rows)).collect()}
    assert len(out) == len(rows)
    off, prints = [], {}
    for p, (i, text) in enumerate(rows):
        after = rows[(p + 1) % len(rows)][1]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        off += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
        assert prints.setdefault(tuple(cases.WORDS.findall(text)), r.fingerprint) == r.fingerprint
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.12


def test_collision_rate_is_generalised_jaccard(spark):
    """Over many pairs and weights the mean error is near zero."""
    texts = [("a " * i + "b " * j, "a " * j + "c " * i + "b") for i in range(1, 12) for j in range(1, 12)]
    rows = [(2 * p + s, t) for p, pair in enumerate(texts) for s, t in enumerate(pair[::-1])]
    out = {r.doc_id: r for r in fingerprints.fingerprints(cases.table(spark, rows)).collect()}
    off = [out[2 * p + 1].near_next - jaccard(*pair) for p, pair in enumerate(texts)]
    assert abs(np.mean(off)) < 0.06


def test_odd_cases(spark):
    rows = [(1, None), (1, None), (None, ""), (None, "a b"), (2, "x " * 30_000), (3, "a b"), (3, "a b")]
    out = fingerprints.fingerprints(cases.table(spark, rows)).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 0, 3, 3, 3, 60_000]
    assert len({r.fingerprint for r in out if r.n_chars == 3}) == 1
    assert len({r.fingerprint for r in out if r.n_chars == 0}) == 1
    assert fingerprints.fingerprints(cases.table(spark, [])).count() == 0
    (one,) = fingerprints.fingerprints(cases.table(spark, [(5, "one text only")])).collect()
    assert one.near_next == 1.0
