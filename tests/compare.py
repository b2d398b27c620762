"""Row-by-row comparison of a Spark result with DuckDB's."""

import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return con


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.5g}" if float(v) == float(v) else "nan"
    if hasattr(v, "isoformat"):
        return (v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v).isoformat().removesuffix("T00:00:00")
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def same(df, con, sql):
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(found.columns, found.fetchall())
