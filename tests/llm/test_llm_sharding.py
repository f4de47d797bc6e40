import hashlib
from collections import defaultdict

import cases
import pytest
from outskirt.llm import sharding


def bits(i):
    return f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}"


def brute(rows, limit):
    out = {}

    def split(members, prefix):
        if sum(b for _, b in members) <= limit or len(members) == 1:
            out.update({i: (prefix, sum(b for _, b in members), len(members)) for i, b in members})
            return
        for bit in "01":
            if part := [(i, b) for i, b in members if bits(i).startswith(prefix + bit)]:
                split(part, prefix + bit)

    split([(i, len((t or "").encode())) for i, t in rows], "")
    return out


@pytest.mark.parametrize("limit, step", [(10**9, 10), (20_000, 10), (300, 10), (300, 3), (1, 7)])
def test_equals_splitting_by_hand(spark, monkeypatch, limit, step):
    monkeypatch.setattr(sharding, "STEP", step)
    rows = [(i, t) for i, t in dict(cases.texts()).items() if i is not None] + [(1000 + i, "é" * (i % 50)) for i in range(300)]
    rows = [(i, t) for i, t in rows if limit > 1 or t]
    out = {r.doc_id: (r.shard, r.shard_bytes, r.shard_docs) for r in sharding.assign(cases.table(spark, rows), limit).collect()}
    assert out == brute(rows, limit)


def test_repeated_rows_are_split_too(spark, tmp_path):
    rows = [(1, "x" * 100)] * 50 + [(None, "y" * 100)] * 30 + [(2, "z" * 5000)]
    docs = cases.table(spark, rows)
    out = sharding.assign(docs, 1000).collect()
    assert len(out) == 81
    size = defaultdict(int)
    for r in out:
        size[r.shard] += r.doc_bytes
    assert all(size[r.shard] == r.shard_bytes and (r.shard_bytes <= 1000 or r.shard_docs == 1) for r in out)
    folder = f"file://{tmp_path}/shards"
    sharding.write(docs, folder, 1000)
    back = spark.read.parquet(folder)
    assert back.count() == 81 and back.select("shard").distinct().count() == len(size)


def test_only_few_rows_are_broadcast(spark, monkeypatch):
    """Cells grow with the documents; their files are so small that Spark's own check would broadcast millions of rows."""
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 1100, raising=False)
    plans, stored = {}, sharding.stored

    def seen(frame, folder, name, *rest):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return stored(frame, folder, name, *rest)

    monkeypatch.setattr(sharding, "stored", seen)
    rows = [(i, "x" * 10) for i in range(3000)] + [(i // 2, "y" * 10) for i in range(10_000, 14_000)]
    out = {(r.doc_id, r.shard) for r in sharding.assign(cases.table(spark, rows), 15).collect()}
    assert len({s for _, s in out}) == 7000
    large = {name: plan for name, plan in plans.items() if name in ("hashed", "buckets20", "placed20")}
    assert len(large) == 3 and all("SortMergeJoin" in x and "Broadcast" not in x for x in large.values())
    assert "BroadcastHashJoin" in plans["placed10"]


def test_empty_table(spark):
    assert sharding.assign(cases.table(spark, [])).count() == 0
