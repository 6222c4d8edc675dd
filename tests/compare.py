"""Side-by-side comparison of a query with its SQL in DuckDB, in any row order."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()[:19]
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple(map(str, r)))


def same(df, connection, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    q = connection.execute(sql)
    want = rows([x[0] for x in q.description], q.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
