"""Comparison of a query with its SQL."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of(spark, data, query, sql):
    """(rows of the query, rows of the SQL), columns by name, in one order."""
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, data)
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = [tuple(plain(r[k]) for k in order) for r in df.collect()]
    b = [tuple(plain(r[names.index(k)]) for k in order) for r in got.fetchall()]
    return sorted(a, key=str), sorted(b, key=str)
