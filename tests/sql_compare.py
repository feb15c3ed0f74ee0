"""Runs a query and its SQL on the same Parquet files and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)[:19] if hasattr(v, "isoformat") else v


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names, name
    want = Counter(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert got == want, (name, list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
