"""Run a registered query and its SQL side by side and compare rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

# Spark type of a result column -> the type DuckDB must give it.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=0, abs_tol=0) or (math.isnan(a) and math.isnan(b))
    return a == b


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark result and a statement: columns, types, count, rows."""
    names = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*names).collect()), key=_key)
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    fetched = result.fetchall()
    found = []
    if sorted(types) != names:
        return [f"columns: {names} != {sorted(types)}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind) != types[name]:
            found.append(f"type of {name}: {kind} / {types[name]}")
    order = [list(types).index(n) for n in names]
    expected = sorted((tuple(r[i] for i in order) for r in fetched), key=_key)
    if len(rows) != len(expected):
        found.append(f"rows: {len(rows)} != {len(expected)}")
    for got, want in zip(rows, expected):
        if not all(_same(a, b) for a, b in zip(got, want)):
            found.append(f"row: {got} != {want}")
            break
    return found
