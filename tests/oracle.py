"""Runs a registered query and its SQL on one small data set, and compares them."""

from __future__ import annotations

import datetime
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str = DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    """A value as both engines show it."""
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "item"):
        return plain(value.item())
    return value if isinstance(value, (str, int)) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql, sf_dir=DATA):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = connection(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, result.fetchall())
    assert len(got) == len(want)
    assert got == want
    return len(got)
