"""Runs queries beside their SQL in DuckDB and compares rows regardless of order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x: object) -> object:
    if isinstance(x, bool) or x is None or isinstance(x, str | bytes):
        return x
    if isinstance(x, int):
        return x
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime | datetime.date):
        return x.isoformat()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return tuple(plain(v) for v in x)


def rows(names: list[str], data: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def from_sql(sql: str, sf_dir: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def difference(spark, query, sql: str, sf_dir: str) -> str:  # noqa: ANN001
    """Empty if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    names, data = from_sql(sql, sf_dir)
    theirs = rows(names, data)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours == theirs:
        return "" if ours else "no rows"
    extra, missing = sorted(set(ours) - set(theirs))[:3], sorted(set(theirs) - set(ours))[:3]
    return f"{len(ours)} and {len(theirs)} rows; only ours {extra}; only SQL {missing}"
