"""A store of tables in versions: a reader sees one of them whole, whatever a writer does meanwhile."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskwise.sources.shared import bounded

_LOG = "version long, batch string, kind string, name string, folder string, schema string"


class Store:
    """Tables that share a key, under a path.

    Data lie in folders that never change: rows are added by new ones, and rows that go are named there by their keys, so
    a change costs as much as it has rows, not as the store has. The log says which folders a version has. It gets the
    lines of a change in one file, after the data, so a change that fails on the way leaves the version before it. A batch
    that is changed again takes the place of all that it wrote before. One writer at a time, any number of readers.
    Folders that no version needs any more aren't deleted.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _lines(self, version: int | None = None) -> list[Row]:
        """What holds in a version: a line for each folder since the store was last cleared."""
        try:
            lines = self.spark.read.schema(_LOG).json(f"{self.path}/log").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            lines = []
        lines = [r for r in lines if version is None or r["version"] <= version]
        cleared = max((r["version"] for r in lines if r["kind"] == "clear"), default=0)
        newest: dict[str, int] = {}
        for r in lines:
            newest[r["batch"]] = max(newest.get(r["batch"], 0), r["version"])
        return [r for r in lines if r["version"] >= cleared and r["version"] == newest[r["batch"]]]

    def latest(self) -> int:
        """The newest version; 0 before the first."""
        return max((r["version"] for r in self._lines()), default=0)

    def names(self, version: int | None = None) -> list[str]:
        return sorted({r["name"] for r in self._lines(version) if r["kind"] == "rows"})

    def read(self, name: str, version: int | None = None, without: str | None = None) -> DataFrame | None:
        """A table in a version, the newest if none is given, or None if it isn't there. ``without`` leaves out what a
        batch did, as its repetition needs it."""
        lines = [r for r in self._lines(version) if r["batch"] != without]
        mine = [r for r in lines if r["kind"] == "rows" and r["name"] == name]
        if not mine:
            return None
        schema = T.StructType.fromJson(json.loads(max(mine, key=lambda r: r["version"])["schema"]))
        rows = self.spark.read.schema(schema.add("_since", T.LongType())).parquet(*(r["folder"] for r in mine))
        first = min(r["version"] for r in mine)
        gone = [r["folder"] for r in lines if r["kind"] == "gone" and r["version"] > first]
        if gone:
            keys = self.spark.read.schema(T.StructType([T.StructField("_key", schema[self.key].dataType), T.StructField("_gone", T.LongType())])).parquet(*gone)
            keys = bounded(keys.groupBy("_key").agg(F.max("_gone").alias("_gone")))
            rows = rows.join(keys, (F.col(self.key) == F.col("_key")) & (F.col("_since") < F.col("_gone")), "left_anti")
        return rows.drop("_since")

    def change(self, batch: str) -> Change:
        return Change(self, batch)

    def clear(self, batch: str) -> DataFrame:
        """A version without tables; ``name, rows`` of those that were there."""
        counts = [(name, self.read(name).count()) for name in self.names()]
        change = Change(self, batch)
        change.line("clear")
        change.commit()
        return self.spark.createDataFrame(counts, "name string, rows long")

    def compact(self, batch: str) -> int:
        """A version with the same rows, each table in one folder and without keys that are gone. Batches from before it
        can't be repeated."""
        change = Change(self, batch)
        change.line("clear")
        for name in self.names():
            change.add(name, self.read(name))
        return change.commit()


class Change:
    """What a batch adds and removes; readers see it when it is committed."""

    def __init__(self, store: Store, batch: str):
        self.store, self.batch, self.version, self.lines = store, batch, store.latest() + 1, []

    def line(self, kind: str, name: str | None = None, folder: str | None = None, schema: str | None = None) -> None:
        self.lines.append((self.version, self.batch, kind, name, folder, schema))

    def _folder(self, name: str) -> str:
        return f"{self.store.path}/{name}/{uuid.uuid4().hex}"

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes rows of a table; they are returned as they were written."""
        folder = self._folder(name)
        rows.withColumn("_since", F.lit(self.version).cast("long")).write.option("compression", "zstd").parquet(folder)
        self.line("rows", name, folder, rows.schema.json())
        return self.store.spark.read.schema(rows.schema).parquet(folder)

    def remove(self, keys: DataFrame) -> None:
        """Rows of all tables that have these keys, and are older than this change, go."""
        folder = self._folder("gone")
        key = F.col(self.store.key).alias("_key")
        keys.select(key).distinct().withColumn("_gone", F.lit(self.version).cast("long")).write.parquet(folder)
        self.line("gone", None, folder)

    def commit(self) -> int:
        """The new version. A change without lines is one too."""
        if not self.lines:
            self.line("empty")
        self.store.spark.createDataFrame(self.lines, _LOG).coalesce(1).write.mode("append").json(f"{self.store.path}/log")
        return self.version
