"""Run registered queries against their SQL and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
from gridlocus.workload.bindings import GIVEN  # noqa: E402


TIMES = []


def connect(folder: str):
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return ("f", round(value, 6) + 0.0)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql):
    """'' if equal, else a description."""
    t0 = time.time()
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    TIMES.append((t1 - t0, time.time() - t1))
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if got == want:
        return ""
    only_got = [r for r in got if r not in set(want)] if len(got) < 50000 else []
    only_want = [r for r in want if r not in set(got)] if len(got) < 50000 else []
    return f"rows {len(got)} vs {len(want)} {got_cols}\n   spark only {len(only_got)}: {only_got[:3]}\n   sql only {len(only_want)}: {only_want[:3]}"


def main(argv):
    from gridlocus.session import build_session
    from gridlocus.workload import ORACLES, QUERIES, runnable

    folder = "/root/testdata/sf0.01"
    prefixes = argv or [""]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = runnable(fn)(spark, folder)
            if name in ORACLES:
                verdict = compare(df, con, ORACLES[name]) or "ok"
                n = ""
            else:
                n = df.count()
                verdict = "ok (rows only)" if n else "EMPTY"
        except Exception as e:  # noqa: BLE001
            verdict, n = "ERROR " + str(e)[:700], ""
        bad += not verdict.startswith("ok")
        took = "run %.1f sql %.1f" % TIMES[-1] if name in ORACLES and TIMES else ""
        print(f"{name:34s} {time.time() - start:5.1f}s {took} {n} {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
