"""Run registered queries next to their SQL and report differences.

    python tests/check.py [--sf 0.01] [--time] [name-prefix ...]
"""
from __future__ import annotations

import argparse
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v.normalize()))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("float", "nan")
        return ("float", repr(round(v + 0.0, 9)))
    if isinstance(v, int):
        return ("int", v)
    return (type(v).__name__, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in rows], key=str)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_c, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    res = con.execute(sql)
    exp_c, exp = rows_of([d[0] for d in res.description], res.fetchall())
    if got_c != exp_c:
        return len(got), f"columns {got_c} != {exp_c}"
    if len(got) != len(exp):
        return len(got), f"rows {len(got)} != {len(exp)}; e.g. {[x for x in got if x not in exp][:2]} vs {[x for x in exp if x not in got][:2]}"
    bad = [(a, b) for a, b in zip(got, exp) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(got_c, a, b) if x != y]
        return len(got), f"{len(bad)} rows differ; first {diff} in {a}"
    return len(got), None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("prefix", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as entry
    from crateloom.session import build_session
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    import logging
    logging.disable(logging.CRITICAL)
    sf_dir = f"/root/testdata/sf{a.sf}"
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if a.prefix and not any(name.startswith(p) for p in a.prefix):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            n, err = -1, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += err is not None
        flag = "FAIL" if err else ("ok  " if name in oracle else "rows")
        print(f"{flag} {name:34s} {n:7d} rows {time.time() - t:6.2f}s {err or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
