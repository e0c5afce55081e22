"""A query's rows against those of its SQL in DuckDB, without order; columns are matched by name."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return f"{v:.9g}" if isinstance(v, float) else v if abs(v) > 1e8 else f"{float(v):.9g}"


def check(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())
    got = Counter(tuple(plain(x) for x in row) for row in df.select(*[f"`{c}`" for c in sorted(names)]).collect())
    assert sum(got.values()) == sum(want.values())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
