"""Compare registered queries with their SQL text in DuckDB: python -m tests.oracle [-d dir] [keys...]"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from reelframe.fixtures import TABLES


def connect(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _sort_key(row):
    return tuple((v is None, f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b, tol=1e-9) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        if math.isinf(a) or math.isinf(b):
            return a == b
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b


def compare(df, con, sql: str) -> str:
    """'ok', 'close' (equal up to the last digits) or a description of the difference."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cur.description}
    order = sorted(names)
    exp = cur.fetchall()
    idx = [names.index(c) for c in order]
    exp = sorted([tuple(_norm(r[i]) for i in idx) for r in exp], key=_sort_key)
    got = sorted([tuple(_norm(v) for v in r) for r in df.select(*order).collect()], key=_sort_key)
    for f in df.schema.fields:
        kind, other = f.dataType.simpleString(), types[f.name]
        if other in ("HUGEINT",) or other.startswith("DECIMAL") or kind.startswith("decimal"):
            return f"type of {f.name}: {kind} vs {other}"
        want = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN"}.get(kind)
        if want and want != other:
            return f"type of {f.name}: {kind} vs {other}"
    if len(got) != len(exp):
        return f"ROWS {len(got)} != {len(exp)}"
    exact = True
    for g, e in zip(got, exp):
        for a, b in zip(g, e):
            if not same(a, b):
                return f"got {g} expected {e} in {order}"
            exact &= a == b
    return f"ok {len(got)}" if exact else f"close {len(got)}"


def main():
    from reelframe.plans import QUERIES, SQL
    from reelframe.session import local_session

    p = argparse.ArgumentParser()
    p.add_argument("-d", default="/root/testdata/sf0.01")
    p.add_argument("keys", nargs="*")
    a = p.parse_args()
    spark = local_session()
    con = connect(a.d)
    bad = []
    for k in a.keys or list(QUERIES):
        t = time.time()
        try:
            df = QUERIES[k](spark, a.d)
            r = compare(df, con, SQL[k]) if k in SQL else f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            r = "ERROR " + str(e)[:600]
        if not r.startswith(("ok", "rows")) or r in ("ok 0", "rows 0"):
            bad.append(k)
        print(f"{k:26s} {time.time() - t:6.2f}s {r}", flush=True)
    print("not ok:", bad)


if __name__ == "__main__":
    main()
