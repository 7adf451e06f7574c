"""Run queries beside their SQL on one scale and compare rows, as multisets, columns by name."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pyarrow as pa


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float) and math.isnan(v):
        return "NaN"  # not the same as null
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


def rows(t: pa.Table) -> list[tuple]:
    """Rows as they are: through Arrow, not pandas, which writes NaN for null."""
    cols = sorted(t.column_names)
    return sorted(zip(*[[plain(v) for v in t.column(c).to_pylist()] for c in cols]), key=repr)


def difference(spark_df, sql: str, con) -> str:
    """Empty if both give the same rows."""
    a, b = spark_df.toArrow(), con.sql(sql).arrow()
    b = b.read_all() if hasattr(b, "read_all") else b
    if sorted(a.column_names) != sorted(b.column_names):
        return f"columns {sorted(a.column_names)} / {sorted(b.column_names)}"
    if a.num_rows != b.num_rows:
        return f"rows {a.num_rows} / {b.num_rows}"
    x, y = rows(a), rows(b)
    if x != y:
        bad = [(p, q) for p, q in zip(x, y) if p != q]
        return f"{len(bad)} of {len(x)} differ, first {bad[0]}"
    return ""
