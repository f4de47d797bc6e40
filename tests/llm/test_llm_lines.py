import random
from collections import defaultdict

import cases
import pytest
from outskirt.llm import lines


def brute(rows, min_chars=40, min_docs=5):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(cases.ABC)
    holders = defaultdict(list)
    for i, parts in split:
        for k in {key(x) for x in parts}:
            holders[k].append(-(2**63) if i is None else i)
    gone = {k: max(h) for k, h in holders.items() if len(k) >= min_chars and len(h) >= min_docs}
    out = []
    for i, parts in split:
        kept = [x for x in parts if gone.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_equals_brute_force(spark, batches):
    docs = cases.table(spark)
    out = lines.drop_repeated_lines(docs, batches=batches, fanout=2)
    assert got(out) == brute(cases.texts())
    assert set(cases.CLASHING) <= set(out.columns)


def test_random_lines(spark):
    rng = random.Random(1)
    pool = ["".join(rng.choices("abC é", k=rng.choice([38, 39, 40, 41, 60]))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 5)))) for i in range(60)]
    assert got(lines.drop_repeated_lines(cases.table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert lines.drop_repeated_lines(cases.table(spark, [])).count() == 0


def test_runs_are_compacted_and_keep_the_first_keeper(spark):
    from outskirt.llm.shared import shared_folder

    runs = lines.LineRuns(spark, shared_folder(spark), fanout=2)
    for keeper in (9, 5, 3, 1):
        runs.add(spark.createDataFrame([(1, 1, keeper, 2), (keeper, 0, keeper, 1)], "h1 long, h2 long, keeper long, n long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    found = {(r.h1, r.h2): (r.keeper, r.n) for r in lines.totals(runs.rows()).collect()}
    assert found == {(1, 1): (9, 8), **{(k, 0): (k, 1) for k in (9, 5, 3, 1)}}


def test_totals_over_several_runs_of_many_keys(spark):
    from outskirt.llm.shared import shared_folder

    runs = lines.LineRuns(spark, shared_folder(spark), fanout=9)
    for keeper in (5, 4, 3):
        runs.add(spark.range(3000).selectExpr("id as h1", "id * 7 as h2", f"{keeper}L as keeper", "2L as n"))
    found = lines.totals(runs.rows()).groupBy("keeper", "n").count().collect()
    assert [(r.keeper, r.n, r["count"]) for r in found] == [(5, 6, 3000)]
