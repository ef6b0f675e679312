"""Spark results against DuckDB on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, sql: str, sf_dir: str) -> str:
    """Empty if both hold the same columns and rows."""
    rel = duck(sf_dir).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    return next((f"{g} and {w}" for g, w in zip(got[1], want[1], strict=True) if g != w), "")
