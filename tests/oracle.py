"""Run registered queries next to their checking SQL: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    return v


def _kind(v):
    if isinstance(v, bool):
        return "bool"
    return type(v).__name__


def compare(spark_df, con, sql) -> str | None:
    """None when rows agree, else a short description of the first difference."""
    rows = spark_df.collect()
    cols = sorted(spark_df.columns)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    if cols != sorted(want_cols):
        return f"columns {cols} != {sorted(want_cols)}"
    want = [dict(zip(want_cols, r)) for r in cur.fetchall()]
    got_rows = sorted((tuple(_norm(r[c]) for c in cols) for r in rows), key=repr)
    want_rows = sorted((tuple(_norm(r[c]) for c in cols) for r in want), key=repr)
    if len(got_rows) != len(want_rows):
        return f"rows {len(got_rows)} != {len(want_rows)}"
    diffs = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    if diffs:
        g, w = diffs[0]
        bad = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
        return f"{len(diffs)}/{len(got_rows)} rows differ, first: {bad[:4]}"
    for i, c in enumerate(cols):
        kinds = {_kind(r[i]) for r in got_rows if r[i] is not None}, {_kind(r[i]) for r in want_rows if r[i] is not None}
        if kinds[0] != kinds[1]:
            return f"type of {c}: {kinds[0]} != {kinds[1]}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                msg, n = None, len(df.collect())
                status = f"ROWS {n}"
            else:
                msg = compare(df, con, sql)
                status = "OK" if msg is None else f"BAD {msg}"
        except Exception as e:  # report and go on with the next query
            msg, status = "error", f"ERR {type(e).__name__}: {str(e)[:600]}"
        bad += msg is not None
        print(f"{time.time() - start:6.2f}s {name}: {status}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
