"""Run registered queries beside their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
import traceback
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, path):
    """(ok, message, n_rows, seconds)"""
    t0 = time.time()
    df = fn(spark, path)
    rows = [tuple(r) for r in df.collect()]
    sec = time.time() - t0
    cols, got = canon(df.columns, rows)
    if sql is None:
        return True, "rows only", len(got), sec
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    otypes = dict((d[0], str(d[1])) for d in cur.description)
    ocols2, want = canon(ocols, cur.fetchall())
    if cols != ocols2:
        return False, f"columns {cols} != {ocols2}", len(got), sec
    for f in df.schema.fields:
        ft, ot = f.dataType.simpleString(), otypes[f.name]
        pair = {"bigint": ("BIGINT",), "double": ("DOUBLE",), "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "bool"), "int": ("INTEGER",)}.get(ft)
        if pair is None or not any(p.lower() in ot.lower() for p in pair):
            if not (ft == "bigint" and "NUMBER" in ot.upper()):
                return got == want and False, f"type of {f.name}: {ft} vs {ot}", len(got), sec
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return False, f"rows {len(got)} vs {len(want)}; first differences {diff}", len(got), sec
    return True, "match", len(got), sec


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from evalspark.session import build_session

    path = argv[0]
    pats = argv[1:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(path)
    sqls = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            ok, msg, n, sec = compare(spark, con, name, fn, sqls.get(name), path)
        except Exception as e:  # noqa: BLE001
            ok, msg, n, sec = False, f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
            if "-v" in pats:
                traceback.print_exc()
        print(f"{'ok ' if ok else 'BAD'} {name:42s} {n:7d} rows {sec:6.2f}s {msg[:900]}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
