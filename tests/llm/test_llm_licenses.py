import re

import cases
import duckdb
from outskirt.llm import licenses, queries

PHRASES = dict(licenses.PHRASES)


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(cases.ABC))
    at = [(i, l) for p, l in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({l for _, l in at}))


ROWS = [
    (100, "MIT License. mit-license; the mit\tlicense MIT"),
    (101, "x GNU General Public\nLicense gnu general public licensee, CC-BY cc by cc"),
    (102, "Apache License" * 3 + " apache license apache license"),
    (103, "Permission is hereby granted, free of charge, to really any person obtaining a copy of this software"),
    (104, "Permission is hereby granted " + "filler " * 60 + "free of charge to any person obtaining a copy of this software"),
    (105, "ÉCOLE mité licenseé cc\x7fby 2 mit\xa0license"),
]


def test_base_columns_equal_brute_force(spark):
    rows = cases.texts() + ROWS
    out = licenses.scan(cases.table(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=repr)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=repr)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)


def test_merged_diagonals_find_a_changed_notice(spark):
    out = {r.doc_id: r for r in licenses.scan(cases.table(spark, ROWS)).collect()}
    assert out[103].labels == "mit-text" and 0.8 <= out[103].score < 1
    assert out[104].labels == ""


def test_empty_table(spark):
    assert licenses.scan(cases.table(spark, [])).count() == 0


def test_templates_fit_a_mask():
    assert max(len(words.split()) for words, _ in licenses.PHRASES + licenses.NOTICES) <= 63


def found(text):
    """Labels and score by the definition: shares of template positions in windows of merged diagonals."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(cases.ABC))
    labels, best = set(filter(None, base(text)[4].split(","))), float(bool(base(text)[1]))
    for _, label, phrase, template in licenses.TEMPLATES:
        if phrase:
            continue
        grams = len(template) - 1
        hits = [(p, t) for p in range(len(words) - 1) for t in range(grams) if words[p : p + 2] == template[t : t + 2]]
        island, last, islands = -1, None, {}
        for d in sorted({p - t for p, t in hits}):
            island += last is None or d - last > licenses.BAND
            last, islands[d] = d, island
        for start in {(islands[p - t], p) for p, t in hits}:
            seen = {t for p, t in hits if islands[p - t] == start[0] and start[1] <= p < start[1] + grams + licenses.SLACK}
            best = max(best, len(seen) / grams)
            if len(seen) / grams >= licenses.COVERED:
                labels.add(label)
    return ",".join(sorted(labels)), best


def whole(label):
    return next(text for text, l in licenses.TEXTS if l == label)


LONG = [
    *((200 + i, f"Copyright 2020 someone. {text} some code") for i, (text, _) in enumerate(licenses.TEXTS)),
    (220, whole("mit-full").replace("without restriction", "with no restriction at all").replace("TORT", "tort (or delict)")),
    (221, " ".join(whole("isc").split()[:60])),
    (222, whole("zlib") + " " + whole("zlib") + " " + whole("unlicense")),
    (223, "of the software or the use " * 80 + whole("bsd-2-clause") + " of the software" * 50),
    (224, " ".join(reversed(whole("mit-full").split()))),
]
REPEATED = [
    (301, "Licensed under the Apache License, Version 2.0. 2.0.1 2.0.2 2.0.3 2.0.4"),
    (302, "Licensed under CC BY 4.0 CC BY 4.0 CC BY 4.0 CC BY 4.0"),
    (304, "2.0 " * 40 + "under the license version " + "2.0 " * 40),
]


def test_labels_and_score_equal_brute_force(spark):
    rows = cases.texts()[:12] + ROWS + LONG + REPEATED
    out = {r.doc_id: r for r in licenses.scan(cases.table(spark, rows)).collect()}
    for i, text in rows:
        labels, score = found(text)
        assert (out[i].labels, round(out[i].score, 12)) == (labels, round(score, 12)), i
    for i, (_, label) in enumerate(licenses.TEXTS):
        assert label in out[200 + i].labels.split(",") and out[200 + i].score == 1
    assert "mit-full" in out[220].labels and "isc" not in out[221].labels and {"zlib", "unlicense"} <= set(out[222].labels.split(","))
    assert "bsd-2-clause" in out[223].labels.split(",") and "bsd-3-clause" not in out[223].labels.split(",")
    assert "mit-full" not in out[224].labels
    assert licenses.MASKS > 1


def test_sql_follows_the_operator(spark):
    rows = ROWS + LONG + REPEATED
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cur = con.execute(queries.SQL["op6_licenses"])
    names = [d[0] for d in cur.description]
    want = {r["doc_id"]: r for r in (dict(zip(names, row)) for row in cur.fetchall())}
    got = {r.doc_id: r.asDict() for r in licenses.scan(cases.table(spark, rows)).collect()}
    assert got == want


def test_a_notice_next_to_repeated_fragments(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0. 2.0.1 2.0.2 2.0.3 2.0.4"),
        (2, "Licensed under CC BY 4.0 CC BY 4.0 CC BY 4.0 CC BY 4.0"),
        (3, "2.0 " * 40 + "Licensed under the Apache License, Version 2.0"),
        (4, "2.0 " * 40 + "under the license version " + "2.0 " * 40),
    ]
    out = {r.doc_id: r for r in licenses.scan(cases.table(spark, rows)).collect()}
    found = {i: set(r.labels.split(",")) for i, r in out.items()}
    assert "apache-2.0" in found[1] & found[3] and "cc-by-4.0" in found[2] and found[4] == {""}
    assert out[1].score == out[2].score == out[3].score == 1 and out[4].score < 0.8
