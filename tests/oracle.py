"""Compares a query with its SQL in DuckDB, whatever the order of rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def plain(v: object) -> object:
    if isinstance(v, float):
        return round(v, 6)
    return v


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def difference(df: DataFrame, sf_dir: str, sql: str) -> str:
    """Empty if equal."""
    (a_names, a), (b_names, b) = spark_rows(df), duck_rows(sf_dir, sql)
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:2]}, only there {list((b - a).items())[:2]}"
    return ""
