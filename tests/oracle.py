"""Side-by-side comparison of registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def canonical(rows, columns: list[str]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(name: str, spark, sf_dir: str, queries: dict, oracles: dict, con) -> tuple[str, float]:
    """('' or a description of the mismatch, seconds of the Spark query)."""
    start = time.time()
    df = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in oracles:
        return ("" if rows else "no rows"), took
    result = con.execute(oracles[name])
    columns = [d[0] for d in result.description]
    expected_columns, expected = canonical(result.fetchall(), columns)
    got_columns, got = canonical(rows, df.columns)
    if got_columns != expected_columns:
        return f"columns {got_columns} vs {expected_columns}", took
    if got != expected:
        have, want = set(got), set(expected)
        missing = [r for r in expected if r not in have][:3]
        extra = [r for r in got if r not in want][:3]
        return f"{len(got)} rows vs {len(expected)}; missing {missing}; extra {extra}", took
    if not got:
        return "both empty", took
    return "", took


def default_dir(sf: str) -> str:
    return str(Path("/root/testdata") / f"sf{sf}")
