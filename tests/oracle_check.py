"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compare = row count + column names + order-insensitive hash of values.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def frame_digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as exc:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(exc)[:300])
            if verbose:
                print(f"{name:28s} SPARK_ERROR {str(exc)[:300]}")
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = ("ROWS_ONLY", len(srows))
            if verbose:
                print(f"{name:28s} rows-only {len(srows)} rows  spark {t1 - t0:.1f}s")
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            results[name] = ("SQL_ERROR", str(exc)[:300])
            if verbose:
                print(f"{name:28s} SQL_ERROR {str(exc)[:300]}")
            continue
        sh, sl = frame_digest(scols, srows)
        dh, dl = frame_digest(dcols, drows)
        ok = (sorted(scols) == sorted(dcols)) and len(srows) == len(drows) and sh == dh
        results[name] = ("OK" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{name:28s} {'OK' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)} "
                  f"{t1 - t0:.1f}s")
            if not ok:
                if sorted(scols) != sorted(dcols):
                    print("   cols", sorted(scols), sorted(dcols))
                diff_s = [x for x in sl if x not in set(dl)][:3]
                diff_d = [x for x in dl if x not in set(sl)][:3]
                print("   spark-only", diff_s)
                print("   duck-only ", diff_d)
    return results


if __name__ == "__main__":
    from txsentinel.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", shuffle_partitions=8,
                        extra_conf={"spark.driver.memory": "6g"})
    r = check(spark, sf, names)
    bad = {k: v for k, v in r.items() if v[0] not in ("OK", "ROWS_ONLY")}
    print("SUMMARY", len(r), "queries;", len(bad), "bad:", sorted(bad))
