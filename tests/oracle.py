"""Runs SQL in DuckDB over the Parquet tables of a folder and compares rows without order."""

import math
from datetime import datetime
from pathlib import Path

import duckdb


def rows(columns, data):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        if isinstance(x, datetime):
            return x.replace(tzinfo=None).isoformat()
        return x

    return sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in data)


def of_sql(sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.sql(sql)
    return rows(found.columns, [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()])


def of_spark(df):
    return rows(df.columns, [r.asDict() for r in df.collect()])
