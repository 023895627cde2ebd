"""Runs a query and its SQL counterpart on the same folder and compares them."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def _text(value: object) -> str:
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return "[" + ",".join(_text(v) for v in value) + "]"
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "~"
    if isinstance(value, bool) or type(value).__name__.startswith("bool"):
        return str(bool(value))
    try:
        return f"{float(value):.9g}" if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(_text(v) for v in r) for r in ordered.itertuples(index=False, name=None))


def difference(spark, con: duckdb.DuckDBPyConnection, folder: str, query, sql: str) -> str:
    """Empty if both agree, else what differs."""
    mine, theirs = query(spark, folder).toPandas(), con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = rows(mine), rows(theirs)
    if a != b:
        return f"{len(a)} and {len(b)} rows; only here {sorted(set(a) - set(b))[:3]}, only in SQL {sorted(set(b) - set(a))[:3]}"
    return ""
