"""Run registered queries next to their SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    """Exact text of a value; integer, float and decimal stay apart."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, int, float)):
        return repr(value)
    if isinstance(value, Decimal):
        return f"D{value}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, folder, fn, sql):
    """(ok, message) for one query."""
    df = fn(spark, folder)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows={len(got)} (no SQL)"
    result = con.execute(sql)
    want, want_names = rows_of([d[0] for d in result.description], result.fetchall())
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; first {got[:1]} vs {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first {bad[0][0]} vs {bad[0][1]}"
    return True, f"rows={len(got)}"


def main(folder: str, *wanted: str) -> int:
    import __spark_entry__ as entry
    from panelworks.session import build_session

    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, folder, fn, sqls.get(name))
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.2f}s {message}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
