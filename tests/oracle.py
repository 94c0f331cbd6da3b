"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares all rows."""

import glob
import math
import os
from collections import Counter

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(sf_dir).execute(sql)
    want = bag([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0]
    extra, lacking = got[1] - want[1], want[1] - got[1]
    assert not extra and not lacking, f"{sum(extra.values())} extra {list(extra)[:2]}, {sum(lacking.values())} lacking {list(lacking)[:2]}"
    return sum(want[1].values())
