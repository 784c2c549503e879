"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def database(sf_dir=SF):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return round(float(v), 7) if hasattr(v, "as_tuple") else v


def compare(frame, con, sql):
    names = sorted(frame.columns)
    found = con.execute(sql)
    told = [d[0] for d in found.description]
    assert sorted(told) == names
    want = sorted((tuple(plain(r[told.index(n)]) for n in names) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)
    assert got == want
