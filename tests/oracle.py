"""Spark and DuckDB results of a query, compared without regard to order."""

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def text(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted([text(r[n]) for n in names] for r in df.collect())


def oracle_rows(con, sql):
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([text(r[i]) for i in order] for r in out.fetchall())
