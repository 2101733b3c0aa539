"""Runs registered queries next to their SQL: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(frame, con, sql: str) -> str | None:
    """First difference between a Spark result and a SQL result, or None."""
    result = con.execute(sql)
    want_columns, want = normal([d[0] for d in result.description], result.fetchall())
    got_columns, got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got == want:
        return None
    missing = [r for r in want if r not in set(got)][:3]
    extra = [r for r in got if r not in set(want)][:3]
    return f"{len(got)} rows, want {len(want)}; extra {extra}; missing {missing}"


def main() -> int:
    import __spark_entry__ as entry
    from tallyhouse.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, sql, bad = local_session(), connect(folder), entry.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            frame = entry.queries()[name](spark, folder)
            problem = difference(frame, con, sql[name]) if name in sql else f"no sql, {frame.count()} rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        if problem:
            bad += 1
        print(f"{time.time() - start:6.2f}s {name}: {problem or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
