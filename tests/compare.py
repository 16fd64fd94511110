"""Run queries next to their SQL and compare the rows."""

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float) and (math.isnan(value) or (value == 0 and math.copysign(1, value) < 0)):
        return repr(value)  # never equal to null or to plain zero
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def sortable(row):
    return tuple((v is None, str(type(v)) if v is None else "", "" if v is None else v) for v in row)


def difference(df, con, sql):
    """None if both give the same columns and the same bag of rows, else a short text."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=sortable)
    columns = sorted(df.columns)
    actual = sorted((tuple(plain(v) for v in r) for r in df.select([f"`{c}`" for c in columns]).collect()), key=sortable)
    if len(actual) != len(expected):
        return f"{len(actual)} rows against {len(expected)}; first {actual[:1]} {expected[:1]}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    return f"{len(wrong)} of {len(actual)} rows differ in {columns}, first {wrong[0]}" if wrong else None
