"""Holding a query's rows against its SQL in DuckDB."""

import glob
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = DATA):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def same(df, sql: str, con) -> None:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    place = sorted(range(len(names)), key=names.__getitem__)
    want = Counter(tuple(r[i] for i in place) for r in found.fetchall())
    order = sorted(df.columns)
    got = Counter(tuple(r[c] for c in order) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
