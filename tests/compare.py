"""Run registered queries against their SQL: python tests/compare.py [sf_dir] [name ...]"""

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def clean(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return v if not isinstance(v, bool) else int(v)

    return sorted(columns), sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


# Spark's and DuckDB's names of the column types that the queries return
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, sf, query, sql):
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    types = {name: SAME[kind] for name, kind in df.dtypes}
    return (types, *got), ({d[0]: str(d[1]) for d in cur.description}, *want)


if __name__ == "__main__":
    from conftest import make_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = make_session(), connect(sf)
    for name in names:
        t = time.time()
        try:
            if name not in entry.oracle_sql():
                n = entry.queries()[name](spark, sf).count()
                print(f"{name:22} rows only {n:6} {time.time() - t:6.1f}s", flush=True)
                continue
            got, want = compare(spark, con, sf, entry.queries()[name], entry.oracle_sql()[name])
            ok = got == want
            print(f"{name:22} {'ok  ' if ok else 'DIFF'} {len(got[2]):6} {len(want[2]):6} {time.time() - t:6.1f}s", flush=True)
            if not ok:
                a, b = set(got[2]), set(want[2])
                print("   columns", got[:2], want[:2], "\n   only ours", sorted(a - b, key=repr)[:3], "\n   only sql", sorted(b - a, key=repr)[:3])
        except Exception as e:  # keep going: this is a report
            print(f"{name:22} ERROR {str(e)[:600]}", flush=True)
