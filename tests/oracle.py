"""A query's rows against DuckDB's, column names sorted, as multisets."""

from __future__ import annotations

import datetime
import decimal
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(row[i]) for i in order) for row in cur.fetchall())


def sparked(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(row[n]) for n in names) for row in df.collect())


def difference(df, sf_dir: str, sql: str) -> str | None:
    (a, x), (b, y) = sparked(df), duck(sf_dir, sql)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        return f"{sum(x.values())} and {sum(y.values())} rows; only in Spark {list((x - y).items())[:3]}, only in DuckDB {list((y - x).items())[:3]}"
    return None
