"""The versioned store against a dictionary; changes that fail, are repeated, cleared and compacted."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from deskwise.operators import ingest
from deskwise.sources.shared import fresh_path
from deskwise.sources.versions import Store

SCHEMA = "doc_id long, text string"


@pytest.fixture
def store(spark):
    return Store(spark, fresh_path(spark, "versions"))


def whole(rows):
    return rows.select("doc_id", F.col("text").alias("content"))


def plain(rows):
    return rows


def add(store, rows, batch, force=False):
    docs = store.spark.createDataFrame(rows, SCHEMA)
    return ingest.add_documents(store, docs, batch, force, prepare=whole, encode=plain)


def rows(store, name="chunks", version=None):
    found = store.read(name, version)
    return None if found is None else sorted(map(tuple, found.collect()))


def test_every_version_stays(store):
    held, told = {}, {}
    steps = [("put", {1: "a", 2: "b", 3: "c"}), ("put", {3: "not new", 4: "d"}), ("force", {1: "A", 5: "e"}), ("gone", [2, 4, 77]), ("put", {2: "again"}), ("force", {2: "B", 3: "C"}), ("gone", [])]
    for number, (kind, what) in enumerate(steps):
        if kind == "gone":
            change = store.change(f"b{number}")
            change.remove(store.spark.createDataFrame([(k,) for k in what], "doc_id long"))
            version = change.commit()
            held = {k: v for k, v in held.items() if k not in what}
        else:
            add(store, list(what.items()), f"b{number}", kind == "force")
            version = store.latest()
            held = {**held, **what} if kind == "force" else {**what, **held}
        told[version] = sorted(held.items())
    assert list(told) == list(range(1, len(steps) + 1))
    for version, expected in told.items():
        assert rows(store, "chunks", version) == rows(store, "docs", version) == expected
    assert store.compact("small") == len(steps) + 1
    assert rows(store) == told[len(steps)] and rows(store, "docs", 2) == told[2]
    assert sorted(map(tuple, store.clear("end").collect())) == [("chunks", len(held)), ("docs", len(held))]
    assert store.read("chunks") is None and store.names() == [] and rows(store, "chunks", 1) == told[1]
    add(store, [(9, "z")], "after")
    assert rows(store) == [(9, "z")]


def test_a_change_that_fails_isnt_seen(store):
    assert store.latest() == 0 and store.read("docs") is None
    add(store, [(1, "a")], "first")

    @F.udf("string")
    def broken(text):
        raise ValueError(text)

    docs = store.spark.createDataFrame([(1, "b"), (2, "c")], SCHEMA)
    with pytest.raises(PythonException):
        ingest.add_documents(store, docs, "second", True, prepare=lambda d: whole(d).withColumn("content", broken("content")), encode=plain)
    assert store.latest() == 1 and rows(store) == rows(store, "docs") == [(1, "a")]
    add(store, [(1, "b"), (2, "c")], "second", True)
    assert store.latest() == 2 and rows(store) == [(1, "b"), (2, "c")]


def test_a_repeated_batch_replaces_itself(store):
    add(store, [(1, "a")], "first")
    add(store, [(2, "half")], "second")
    add(store, [(1, "skipped"), (2, "b"), (3, "c")], "second")
    assert rows(store) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(store, "chunks", 2) == [(1, "a"), (2, "half")]
    # A replacement that is repeated without one of its documents gives that back.
    add(store, [(1, "A"), (3, "C")], "third", True)
    add(store, [(3, "C")], "third", True)
    assert rows(store) == [(1, "a"), (2, "b"), (3, "C")]


def test_odd_documents(store):
    add(store, [], "empty")
    assert rows(store) == [] and store.latest() == 1
    add(store, [(None, "no id"), (1, None), (2, ""), (2, "")], "odd")
    assert rows(store) == [(1, None), (2, "")]
    change = store.change("nothing")
    assert change.commit() == 3 and rows(store) == [(1, None), (2, "")]
