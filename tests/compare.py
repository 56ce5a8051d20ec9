"""Compare a Spark result with a DuckDB one, whatever the order of rows and columns."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(names, rows):
    order = sorted(names)
    return sorted((tuple(plain(dict(zip(names, r))[c]) for c in order) for r in rows), key=repr)


def check(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = rows_of(names, found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(expected)
    assert got == expected
