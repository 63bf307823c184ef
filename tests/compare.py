"""Spark results against DuckDB's for the same SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        return cell(v.item())
    try:
        return f"{float(v):.9g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def same(spark, query, sql, folder):
    got = query(spark, folder)
    cursor = connect(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    mine, theirs = rows(got.columns, got.collect()), rows(names, cursor.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
    return len(mine)
