"""Run a registered query on Spark and its oracle SQL on DuckDB; compare.

Usage: python tests/oracle_harness.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(v))
    if isinstance(v, bool):
        return (2, str(int(v)))
    if isinstance(v, int):
        return (1, repr(float(v)))
    if isinstance(v, (list, tuple)):
        return (3, str([_norm(x) for x in v]))
    if isinstance(v, dict):
        return (3, str(sorted((k, _norm(x)) for k, x in v.items())))
    if hasattr(v, "asDict"):
        return (3, str(sorted((k, _norm(x)) for k, x in v.asDict().items())))
    return (4, str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    t2 = time.time()
    a, ac = canon(scols, srows)
    b, bc = canon(dcols, drows)
    ok = ac == bc and a == b
    msg = f"{name}: spark {len(a)} rows {t1-t0:.1f}s duck {len(b)} rows {t2-t1:.1f}s -> {'OK' if ok else 'MISMATCH'}"
    if not ok:
        if ac != bc:
            msg += f"\n  cols spark={ac}\n  cols duck ={bc}"
        else:
            sa, sb = set(a), set(b)
            msg += f"\n  only spark: {sorted(sa - sb)[:3]}\n  only duck : {sorted(sb - sa)[:3]}"
    return ok, msg


def main():
    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    import __spark_entry__ as E
    from quarry.session import get_spark
    spark = get_spark("oracle-check", master="local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            print(f"{name}: no oracle; spark rows={df.count()}")
            continue
        try:
            ok, msg = compare(spark, con, sf_dir, name, qs[name], sqls[name])
        except Exception as e:  # report and continue
            ok, msg = False, f"{name}: ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(msg, flush=True)
    print(f"mismatches: {bad}")


if __name__ == "__main__":
    main()
