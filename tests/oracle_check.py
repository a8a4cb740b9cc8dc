"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names/types and order-insensitive values.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from xgspark.sources.tables import TABLES  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v)
    return repr(v)


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    scols = sdf.columns
    stypes = [SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields]
    if sql is None:
        return f"{name}: rows-only {len(srows)} rows ({t1 - t0:.2f}s)", True
    rel = con.sql(sql)
    dcols, dtypes = rel.columns, [str(t) for t in rel.types]
    drows = rel.fetchall()
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns spark={scols} duck={dcols}")
    else:
        st = dict(zip(scols, stypes))
        dt = dict(zip(dcols, dtypes))
        bad = {c: (st[c], dt[c]) for c in scols if st[c] != dt[c]}
        if bad:
            problems.append(f"types {bad}")
    if len(srows) != len(drows):
        problems.append(f"rows spark={len(srows)} duck={len(drows)}")
    if not problems:
        dmap = [dcols.index(c) for c in scols]
        drows2 = [tuple(r[i] for i in dmap) for r in drows]
        a, b = rows_key(scols, srows), rows_key(scols, drows2)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            nd = sum(1 for x, y in zip(a, b) if x != y)
            problems.append(f"values differ in {nd} rows, e.g. {diff}")
    ok = not problems
    return f"{name}: {'OK' if ok else 'FAIL'} {len(srows)} rows ({t1 - t0:.2f}s) {'; '.join(problems)}", ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as E
    from xgspark.session import build_session

    spark = build_session("local[8]", "oracle-check", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    n_ok = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            msg, ok = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            msg, ok = f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}", False
        n_ok += ok
        print(msg, flush=True)
    print(f"{n_ok} ok")


if __name__ == "__main__":
    main(sys.argv)
