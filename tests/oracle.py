"""Compare registered queries with their SQL on the same tables, the whole result row by row."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> tuple[str | None, int]:
    """Description of the first difference, or None, and the number of rows."""
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = _rows(want_columns, cursor.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(want_columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_columns)}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; got {got[:2]} want {want[:2]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return (f"{len(bad)} rows differ: {bad[:2]}" if bad else None), len(got)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from gradus.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf)
    sql = oracle_sql()
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                diff, n = differences(query(spark, sf), con, sql[name])
            else:
                diff, n = "no SQL", query(spark, sf).count()
        except Exception as e:  # report and go on with the next query
            diff, n = f"{type(e).__name__} {str(e)[:600]}", -1
        print(f"{name:28s} {n:8d} rows {time.time() - start:6.1f}s  {diff or 'equal'}", flush=True)
