"""Rows of a query and of its SQL on the same tables, made comparable."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata/sf0.001")


def connect(folder=DATA):
    c = duckdb.connect()
    for t in TABLES:
        if (Path(folder) / f"{t}.parquet").exists():
            c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}") + 0.0
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


def same(df, sql, folder=DATA):
    out = connect(folder).sql(sql)
    assert sorted(df.columns) == sorted(out.columns)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(out.columns, out.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
