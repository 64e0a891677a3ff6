"""Run registered queries and their SQL side by side.  python tests/oracle.py [--sf 0.01] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", float(f"{v:.9g}") + 0.0)
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None when equal, else a short text."""
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} vs {sorted(want_names)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; e.g. {[x for x in a if x not in b][:1]} / {[x for x in b if x not in a][:1]}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)}/{len(a)} rows differ ({sorted(got_names)}): {diff[0]}"
    types = {t[0]: str(t[1]) for t in [(d[0], d[1]) for d in cur.description]}
    mism = []
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        dt = types[f.name].lower()
        ok = {"bigint": "bigint", "double": "double", "int": "integer", "string": "varchar", "boolean": "boolean"}.get(st)
        if ok and ok != dt and dt not in ("number",):
            mism.append((f.name, st, dt))
    return f"TYPES {mism}" if mism else None


def main(argv):
    from streamlens.session import local_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    chunk = None
    if "--chunk" in argv:  # cut every stream into chunks of about this many rows
        i = argv.index("--chunk")
        chunk = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    import __spark_entry__ as entry

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    if chunk:
        spark.conf.set("spark.streamlens.chunkRows", chunk)
    path = f"/root/testdata/sf{sf}"
    con = connect(path)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in q:
        if argv and not any(name == a or name.startswith(a + "_") for a in argv):
            continue
        t0 = time.time()
        try:
            if name in o:
                res = compare(q[name](spark, path), con, o[name])
            else:
                n = len(q[name](spark, path).collect())
                res = None if n else "no rows"
                name += f"  [rows {n}]"
        except Exception as e:
            res = f"{type(e).__name__}: {str(e)[:700]}"
        bad += res is not None
        print(f"{'ok  ' if res is None else 'FAIL'} {time.time() - t0:6.2f}s {name} {res or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
