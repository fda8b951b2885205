"""Compare a registered query with its DuckDB text, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return str(v) if v is not None else None


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def assert_same(df, con, sql: str) -> int:
    n1, a = rows_of(df)
    n2, b = rows_of_sql(con, sql)
    assert n1 == n2, (n1, n2)
    extra, missing = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    assert len(a) == len(b) and a == b, f"{len(a)} and {len(b)} rows; only Spark: {extra}; only SQL: {missing}"
    return len(a)


__all__ = ["assert_same", "connect", "glob", "rows_of"]
