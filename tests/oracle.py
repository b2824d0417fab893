"""Compare a query with its SQL: columns by name, rows in any order, floats to 9 digits."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x + 0.0:.9g}" if x else "0"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return [plain(i) for i in x]
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x) if x is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return rows_of(names, got.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both agree."""
    (a, x), (b, y) = spark_rows(df), sql_rows(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if x == y:
        return ""
    only_x, only_y = [r for r in x if r not in set(y)], [r for r in y if r not in set(x)]
    return f"{len(x)} and {len(y)} rows; only Spark {len(only_x)}: {only_x[:2]}; only SQL {len(only_y)}: {only_y[:2]}"
