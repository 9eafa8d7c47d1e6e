"""Rows of a query and of its SQL, made comparable."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(d):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in res.fetchall()), key=repr)
    assert got == want
    return len(got)
