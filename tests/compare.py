"""Run registered queries against their DuckDB oracles: python tests/compare.py [sf] [key prefix ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, Decimal):
        return ("decimal", str(v))
    if isinstance(v, datetime.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(table):
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    return cols, sorted([tuple(_cell(v) for v in r) for r in zip(*data)], key=repr)


def compare(spark, con, fn, sql, sf_dir):
    got_cols, got = rows_of(fn(spark, sf_dir).toArrow())
    want_cols, want = rows_of(con.execute(sql).to_arrow_table())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return not bad, f"{len(got)} rows" + (f", {len(bad)} differ, e.g. {bad[0]}" if bad else "")


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry
    from tidewatch.session import build_session

    os.environ["PYSPARK_SUBMIT_ARGS"] = "--conf spark.ui.showConsoleProgress=false --conf spark.ui.enabled=false --driver-memory 12g pyspark-shell"
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    for key, fn in entry.queries().items():
        if prefixes and not key.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            if key in oracles:
                ok, note = compare(spark, con, fn, oracles[key], sf_dir)
            else:
                t = fn(spark, sf_dir).toArrow()
                ok, note = True, f"no oracle, {t.num_rows} rows, {t.column_names}"
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {key:36s} {time.time() - t0:6.2f}s  {note}", flush=True)
