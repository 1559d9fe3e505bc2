"""A Spark result against DuckDB's for the same query."""

import glob
import os

import duckdb


def plain(value):
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return round(value, 6) if isinstance(value, float) else value


def duck(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def assert_same(rows, columns, relation):
    assert sorted(columns) == sorted(relation.columns)
    order = sorted(columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    places = [relation.columns.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in places) for r in relation.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    assert mine == theirs
