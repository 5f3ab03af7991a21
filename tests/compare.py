"""The same query in Spark and in DuckDB, row by row."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow as pa

SMALL = "/root/testdata/sf0.001"


def kind(t: pa.DataType) -> str:
    if pa.types.is_integer(t):
        return str(t)
    if pa.types.is_floating(t):
        return str(t)
    return "string" if pa.types.is_string(t) or pa.types.is_large_string(t) else str(t)


def rows(table: pa.Table) -> list[tuple]:
    table = table.select(sorted(table.column_names))
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    out = [tuple(plain(x) for x in r.values()) for r in table.to_pylist()]
    return sorted(out, key=repr)


def oracle(sql: str, sf_dir: str) -> pa.Table:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        where = f"{f}/*.parquet" if f.is_dir() else f
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{where}'")
    return con.execute(sql).to_arrow_table()


def differences(found: pa.Table, expected: pa.Table) -> str:
    """What sets the two apart; nothing if nothing does."""
    if sorted(found.column_names) != sorted(expected.column_names):
        return f"columns {sorted(found.column_names)} and {sorted(expected.column_names)}"
    for name in found.column_names:
        a, b = kind(found.schema.field(name).type), kind(expected.schema.field(name).type)
        if a != b:
            return f"types of {name}: {a} and {b}"
    a, b = rows(found), rows(expected)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
