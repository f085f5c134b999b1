"""Compare registered queries with their SQL in DuckDB, values as sorted rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_integer_ratio"):
        return str(v)
    return float(v) + 0.0


def rows(records: list[dict]) -> list[tuple]:
    return sorted((tuple(_plain(r[c]) for c in sorted(r)) for r in records), key=str)


def differ(spark_df, con, sql: str) -> str | None:
    """None if both give the same rows, else what differs first."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows([dict(zip(names, r, strict=True)) for r in cur.fetchall()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    got = rows([r.asDict() for r in spark_df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    return next((f"{a} against {b}" for a, b in zip(got, want, strict=True) if a != b), None)
