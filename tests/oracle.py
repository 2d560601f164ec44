"""Holding a query's rows against SQL on the same files."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def by_sql(sql: str, folder: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c.sql(sql).df()


def plain(v):
    if v is None or (isinstance(v, float) and v != v) or str(v) == "<NA>":
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
