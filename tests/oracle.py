"""Compare a query's rows with those of its DuckDB SQL."""

import math
import os

import duckdb
import pandas as pd


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float) and v == int(v):
            v = int(v)
        return repr(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False))


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for p in os.listdir(sf):
        con.sql(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{sf}/{p}'")
    got, want = rows(query(spark, sf).toPandas()), rows(con.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
