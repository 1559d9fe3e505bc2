"""Reading and writing: benchmark items, traces, documents, results."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_SCHEMA = """id string, category string, question string, clean_question string, ground_truth_answer string, chunk_id string,
relevant_chunk_ids array<string>, relevant_urls array<string>, confluence_url string, chunk_text string"""
TRACE_SCHEMA = "request_id string, timestamp timestamp, step int, phase string, thought string, action string, action_input string, observation string"


def read_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The Parquet tables of a folder by name, with the columns and types that are declared; no file is read for them."""
    return {name: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}.parquet") for name, schema in schemas.items()}


def read_database(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int = 64, **options: str) -> DataFrame:
    """A table of a database over JDBC, in ranges of a numeric column, each read by a task of its own."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.options(**options).load()


def read_items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Benchmark items from a JSON array, or from JSON lines, which Spark splits."""
    return spark.read.schema(ITEM_SCHEMA).option("multiLine", not lines).json(path)


def items_to_chunks(items: DataFrame) -> DataFrame:
    """``id, content, file_path``: the items' chunk texts as a corpus, without blank ids or texts."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    kept = items.where(~blank("chunk_id") & ~blank("chunk_text"))
    return kept.select(F.trim("chunk_id").alias("id"), F.trim("chunk_text").alias("content"), F.concat(F.lit("dataset_chunk:"), F.trim("chunk_id")).alias("file_path"))


def write_traces(traces: DataFrame, path: str) -> None:
    """JSON lines without null fields, in a folder for each UTC day."""
    traces.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").option("ignoreNullFields", True).json(path)


def read_traces(spark: SparkSession, path: str, request_id: str) -> DataFrame:
    """The rows of one request in order; blank and broken lines are passed over."""
    rows = spark.read.schema(TRACE_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("request_id") == request_id).orderBy("timestamp", "step")


def corpus_stats(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``name, rows`` of each Parquet table; 0 where there is none."""
    out = None
    for name, path in paths.items():
        try:
            counted = spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            counted = spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("rows"))
        out = counted if out is None else out.unionByName(counted)
    return out


def clear(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Empties each table, keeping its schema; what was there is returned."""
    was = spark.createDataFrame([(r["name"], r["rows"]) for r in corpus_stats(spark, paths).collect()], "name string, rows long")
    for r in was.collect():
        if r["rows"]:
            path = paths[r["name"]]
            spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
    return was


def store_documents(docs: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """Appends chunks (doc_id, ...) by source type; ``doc_id, url, title, status, reason, chunks`` for every document.

    A blank text, or one without chunks, is ``skipped`` with its reason.
    """
    joined = docs.select("doc_id", "source_type").join(chunks, "doc_id")
    joined.write.mode("append").partitionBy("source_type").parquet(path)
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    reason = F.when(F.coalesce(F.trim("text_content"), F.lit("")) == "", "empty text").when(F.col("chunks").isNull(), "no chunks")
    found = docs.join(counts, "doc_id", "left").withColumn("reason", reason)
    return found.select("doc_id", "url", "title", F.when(F.col("reason").isNull(), "ok").otherwise("skipped").alias("status"), "reason", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def write_results(path: str, **frames: DataFrame) -> str:
    """Each frame as JSON lines under one run's folder, whose path is returned."""
    run = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    for name, frame in frames.items():
        frame.write.json(f"{run}/{name}")
    return run
