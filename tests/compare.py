"""Rows of a Spark query against rows of DuckDB SQL over the same tables, whatever their order."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def difference(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs, or an empty text."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(row[names.index(c)] for c in order) for row in found.fetchall())
    have = Counter(tuple(row[c] for c in order) for row in df.collect())
    if want == have:
        return ""
    return f"{sum(have.values())} and {sum(want.values())} rows; only here {list((have - want))[:3]}; only there {list((want - have))[:3]}"
