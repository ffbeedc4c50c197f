"""Rows of a Spark query against rows of DuckDB SQL, without regard to order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(found, columns, order):
    return sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in found), key=repr)


def same(df, sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want, got = rows(rel.fetchall(), sorted(names), names), rows([tuple(r) for r in df.collect()], sorted(names), df.columns)
    assert len(want) == len(got)
    for a, b in zip(got, want, strict=True):
        assert a == b
