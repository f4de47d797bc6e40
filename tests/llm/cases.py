"""Small tables with every odd case, and brute-force versions of what the operators compute."""

import random
import re
import string

ABC = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside.
CLASHING = ["row", "key", "n", "first", "gram", "piece", "cell", "fp", "h1", "keeper", "part", "text_hash", "spans", "id", "score", "n_lines", "component", "rank"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def long_text(rng, n):
    return " ".join("".join(rng.choices("abcde", k=rng.randint(1, 3))) for _ in range(n))


def texts():
    """(doc_id, text): copies, near copies, shared passages and lines, nulls, empties, a long text, repeated rows."""
    rng = random.Random(5)
    passage = long_text(rng, 60)
    line = "A line that many documents have, over forty characters"
    base = long_text(rng, 120)
    rows = [(i, f"{long_text(rng, 30)}\n  {line.upper() if i % 2 else line}\t\n{long_text(rng, 20)}") for i in range(8)]
    rows += [(10 + i, f"{long_text(rng, 15)} {passage} {long_text(rng, 15)}") for i in range(4)]
    rows += [(20, base), (21, base), (22, base.replace("a", "A", 1)), (23, base + " tail")]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "\n"), (34, "one"), (35, "one two three"), (36, "é ñ ÜÇ" * 5)]
    rows += [(40, long_text(rng, 20_000)), (41, "same " * 200), (50, base), (50, base), (50, long_text(rng, 50))]
    rows += [(None, base), (None, None), (60, f"{line}\n{line}\n\n{line.swapcase()}")]
    return rows


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "en", "s", len(t or ""), *(["x"] * len(CLASHING))) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def components(nodes, linked):
    """The smallest node reachable from each of ``nodes`` (sorted)."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}
