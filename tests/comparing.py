"""Results of Spark and DuckDB as comparable rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str):
    made = duckdb.connect()
    made.sql("SET TimeZone='UTC'")
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return made


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def oracle_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return [found.columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
