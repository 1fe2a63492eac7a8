"""Comparison of Spark rows with those of DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(x) for x in row) for row in df.select(columns).collect()), key=str)


def duck_rows(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = c.execute(sql)
    names = [d[0] for d in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in out.fetchall()), key=str)
