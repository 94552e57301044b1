"""Spark's and DuckDB's rows of one query, in a form that compares."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted([tuple(plain(v) for v in r) for r in df.select(*columns).collect()], key=repr)


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted([tuple(plain(r[i]) for i in order) for r in got.fetchall()], key=repr)
