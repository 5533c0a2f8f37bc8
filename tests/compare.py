"""A Spark query against SQL over the same files."""

import os

import duckdb


def settled(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(settled, value))
    return value


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(settled, r)) for r in df.select(*names).collect()), key=repr)


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    found = con.sql(sql)
    names = sorted(found.columns)
    return names, sorted((tuple(map(settled, r)) for r in found.select(*[f'"{n}"' for n in names]).fetchall()), key=repr)
