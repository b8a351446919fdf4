"""Compare registered queries with their SQL counterparts: ``python tests/oracle_check.py [folder] [key prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def key(row):
    return tuple((x is not None, str(type(x)), x) if not isinstance(x, tuple) else (True, "t", str(x)) for x in row)


def compare(spark, con, name, queries, oracles, folder):
    df = queries[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    if name not in oracles:
        return f"rows {len(got)}", True
    rel = con.execute(oracles[name])
    names = [c[0] for c in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}", False
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}", False
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"first difference {g} != {w} ({cols})", False
    return f"ok {len(got)}", True


def main():
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    from risewatch.catalog import ORACLES, QUERIES
    from risewatch.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name in sorted(QUERIES):
        if len(args) > 1 and not any(name.startswith(p) for p in args[1:]):
            continue
        start = time.time()
        try:
            text, ok = compare(spark, con, name, QUERIES, ORACLES, folder)
        except Exception as e:  # noqa: BLE001 - report and go on
            text, ok = f"{type(e).__name__}: {str(e)[:600]}", False
        if not ok:
            bad.append(name)
        print(f"{'    ' if ok else 'BAD '}{name:42s} {time.time() - start:6.2f}s {text}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
