"""Run registered queries in Spark and their SQL twins in DuckDB, and compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Compares column names, row counts and order-insensitive values (exact equality).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from fleetstats.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "DateType": "DATE", "TimestampType": "TIMESTAMP", "TimestampNTZType": "TIMESTAMP",
                 "BooleanType": "BOOLEAN", "ShortType": "SMALLINT", "FloatType": "FLOAT"}


def type_problems(sdf, con, sql):
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__)
        got = duck_types.get(f.name)
        if got is not None and got != want:
            out.append(f"{f.name}: spark={want} duck={got}")
    return out


def compare(spark, con, key, query, sql, sf_dir):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sc, sr = _rows(s_cols, s_rows)
    dc, dr = _rows(d_cols, d_rows)
    problems = []
    if sc != dc:
        problems.append(f"columns differ: spark={sc} duck={dc}")
    types = type_problems(sdf, con, sql)
    if types:
        problems.append("types differ: " + ", ".join(types))
    if len(sr) != len(dr):
        problems.append(f"rows differ: spark={len(sr)} duck={len(dr)}")
    elif sc == dc:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b]
        if bad:
            problems.append(f"{len(bad)} value mismatches, first: spark={bad[0][0]} duck={bad[0][1]}")
    return problems, len(sr), t1 - t0


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as entry
    from fleetstats.session import build_session
    spark = build_session(shuffle_partitions=8)
    qs, ora = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    failed = 0
    for k in keys or sorted(qs):
        if k not in ora:
            df = qs[k](spark, sf_dir)
            n = df.count()
            print(f"{k:28s} rows-only  rows={n}")
            continue
        try:
            problems, n, sec = compare(spark, con, k, qs[k], ora[k], sf_dir)
        except Exception as exc:  # report and continue with the next key
            problems, n, sec = [f"error: {type(exc).__name__}: {str(exc)[:400]}"], -1, 0
        status = "OK" if not problems else "FAIL"
        failed += bool(problems)
        print(f"{k:28s} {status:4s} rows={n} spark={sec:.2f}s {'; '.join(problems)}")
    print(f"failed={failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
