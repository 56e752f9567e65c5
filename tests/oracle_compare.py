"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

STRICT = os.environ.get("ORACLE_STRICT") == "1"  # compare doubles at full precision

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    if os.environ.get("ORACLE_KEEP_TZ") != "1":  # set ORACLE_KEEP_TZ=1 to keep DuckDB's default zone
        con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return f if STRICT else float(f"{f:.9g}")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


SPARK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def type_mismatches(sdf, res):
    spark_t = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    duck_t = {d[0]: str(d[1]) for d in res.description}
    return {c: (spark_t[c], duck_t.get(c)) for c in spark_t if c in duck_t and spark_t[c] != duck_t[c]}


def compare(spark, con, name, fn, oracle, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    scols, s = rows_of(sdf.columns, srows)
    if oracle is None:
        return dict(name=name, ok=None, rows=len(s), spark_s=round(t1 - t0, 2))
    res = con.execute(oracle)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    dcols, o = rows_of(dcols, drows)
    ok = scols == dcols and s == o
    info = dict(name=name, ok=ok, rows=len(s), oracle_rows=len(o), spark_s=round(t1 - t0, 2))
    tm = type_mismatches(sdf, res)
    if tm:
        info["types"] = tm
    if not ok:
        if scols != dcols:
            info["cols"] = (scols, dcols)
        else:
            ss, oo = set(s), set(o)
            info["spark_only"] = list(ss - oo)[:3]
            info["oracle_only"] = list(oo - ss)[:3]
    return info


def main(argv):
    sys.path.insert(0, ".")
    from wavepanel.plans.registry import load_all
    from wavepanel.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    pats = argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name, (fn, q) in sorted(load_all().items()):
        if pats and not any(p in name for p in pats):
            continue
        try:
            info = compare(spark, con, name, fn, q, sf_dir)
        except Exception as e:  # report and continue
            info = dict(name=name, ok=False, error=str(e).splitlines()[0][:300])
        if info.get("ok") is False:
            bad += 1
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
