"""Compare a query with its SQL on DuckDB over the same Parquet files."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, int):
        f = float(v)
        return "NaN" if math.isnan(f) else f"{f:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if sql is None:  # for queries tested otherwise; the callers name them
        assert ours
        return
    cur = connection(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert ours == theirs
