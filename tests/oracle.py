"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows.

``python tests/oracle.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def _sort_key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", v if v is not None else 0)
                 for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=_sort_key)


def duck_rows(con, sql):
    cur = con.execute(sql)
    order = sorted(range(len(cur.description)), key=lambda i: cur.description[i][0])
    names = [cur.description[i][0] for i in order]
    return names, sorted((tuple(_cell(r[i]) for i in order) for r in cur.fetchall()), key=_sort_key)


def duck_types(con, sql):
    return {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}


def differences(a, b) -> str | None:
    (names_a, rows_a), (names_b, rows_b) = a, b
    if names_a != names_b:
        return f"columns {names_a} / {names_b}"
    if len(rows_a) != len(rows_b):
        return f"rows {len(rows_a)} / {len(rows_b)}"
    for x, y in zip(rows_a, rows_b):
        if x != y:
            return f"first difference {x} / {y}"
    return None


def main(argv):
    from tidemark.queries import ORACLE, QUERIES
    from tidemark.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, bad = local_session(cpus=8), connect(sf), []
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            got = spark_rows(df)
            took = time.time() - t0
            if name in ORACLE:
                t1 = time.time()
                want = duck_rows(con, ORACLE[name])
                verdict = differences(got, want) or "ok"
                verdict += f"  duck {time.time() - t1:.2f}s"
                if not verdict.startswith("ok"):
                    verdict += f" {dict(df.dtypes)} {duck_types(con, ORACLE[name])}"
            else:
                verdict = "rows only"
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict, got, took = f"ERROR {type(e).__name__}: {str(e)[:600]}", (None, []), time.time() - t0
        if not verdict.startswith(("ok", "rows only")):
            bad.append(name)
        print(f"{name:26s} {len(got[1]):7d} rows {took:6.2f}s  {verdict}", flush=True)
    print("all agree" if not bad else f"{len(bad)} differ: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
