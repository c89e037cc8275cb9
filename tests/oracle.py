"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import os

FOLDER = "/root/testdata/sf0.001"


def connection():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def agree(spark, query, sql):
    df = query(spark, FOLDER)
    answer = connection().execute(sql)
    want = rows_of([c[0] for c in answer.description], answer.fetchall())
    assert rows_of(df.columns, df.collect()) == want
    return len(want[1])
