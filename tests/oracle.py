"""Compares a query's rows with those of its SQL on the same tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return str(v.date())
    return str(v)


def rows_of_spark(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def rows_of_sql(c, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
