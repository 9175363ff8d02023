"""A Spark query beside SQL that another engine runs on the same tables."""

import datetime
import os

import duckdb


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else repr(v)


def expected(sql, sf_dir):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    q = db.sql(sql)
    columns = sorted(q.columns)
    return columns, sorted(tuple(map(plain, r)) for r in q.project(", ".join(f'"{c}"' for c in columns)).fetchall())
