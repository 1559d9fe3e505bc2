"""Streams over the test tables; where the result is that of a batch query, its SQL checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.operators import ingest
from deskwise.plans.ingestion import EMBEDDED, EMBEDDED_SQL
from deskwise.plans.registry import query
from deskwise.sources import io
from deskwise.sources.shared import fresh_path, written
from deskwise.sources.tables import Tables
from deskwise.sources.versions import Store
from deskwise.streaming import streams as S


def replayed(rows: DataFrame, name: str, files: int = 3) -> DataFrame:
    """A table as a stream of a few files."""
    path = fresh_path(rows.sparkSession, name)
    rows.repartition(files).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def replay_files(rows: DataFrame, name: str, order: str) -> str:
    """The folder of a table's files, each of which has a range of ``order``."""
    path = fresh_path(rows.sparkSession, name)
    rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).write.parquet(path)
    return path


def arriving(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], mode: str, name: str, order: str, parts: int = 2, reports: list | None = None) -> DataFrame:
    """What a stream writes whose table comes in parts, in the order of a number or time. The stream is stopped after
    each part and goes on from its checkpoint when the next one is there."""
    source, path = fresh_path(rows.sparkSession, name), fresh_path(rows.sparkSession, f"stream-{name}")
    at = F.col(order).cast("timestamp").cast("double") if "timestamp" in dict(rows.dtypes)[order] else F.col(order).cast("double")
    placed = written(rows.withColumn("_at", at), name)
    bounds = placed.approxQuantile("_at", [i / parts for i in range(1, parts)], 0.01)
    part = sum((F.coalesce(F.col("_at") > b, F.lit(False)).cast("int") for b in bounds), F.lit(0))
    out = None
    for number in range(parts):
        placed.where(part == number).drop("_at").write.mode("append").parquet(source)
        stream = rows.sparkSession.readStream.schema(rows.schema).parquet(source)
        out = S.drain(transform(stream), mode, name, path, reports)
    return out


@query("x1_questions_per_day", "select bucket, questions from (select date_trunc('day', ts)::timestamp as bucket, count(*) as questions from events group by 1)", ("events",))
def questions_per_day(t: Tables) -> DataFrame:
    # Files come in any order, so the watermark waits for as long as the table lasts; the counts of a day are updated
    # with each file, and the last ones are taken.
    days = t.events.agg(F.date_diff(F.max("ts"), F.min("ts")).alias("d")).first()["d"] or 0
    found = S.drain(S.questions_per_window(replayed(t.events, "events"), late=f"{days + 1} days"), "update", "x1")
    return S.latest_updates(found, "bucket").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "questions")


@query(
    "x1_days_in_order",
    "select date_trunc('day', ts)::timestamp as bucket, count(*) as questions from events group by 1 having date_trunc('day', ts)::timestamp + interval 1 day <= (select max(ts) from events) - interval 6 hours",
    ("events",),
)
def days_in_order(t: Tables) -> DataFrame:
    # Rows come in the order of time, so a watermark of hours loses none; the days that it hasn't passed stay open.
    found = arriving(t.events, lambda rows: S.questions_per_window(rows, late="6 hours"), "append", "x1", "ts")
    return found.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "questions")


@query(
    "x2_user_sessions",
    """select * from (select user_id, min(ts)::timestamp as started_at, max(ts)::timestamp + interval 6 hours as ended_at, count(*) as events from
    (select user_id, ts, sum(begins) over (partition by user_id order by ts, event_id rows unbounded preceding) as number from
    (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hours then 0 else 1 end as begins from events)) group by user_id, number)
    where ended_at <= (select max(ts) from events) - interval 1 day""",
    ("events",),
)
def user_sessions(t: Tables) -> DataFrame:
    found = arriving(t.events, lambda rows: S.user_sessions(rows, gap="6 hours"), "append", "x2", "ts")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


@query("x3_rolling_contexts", r"select session_id, right(string_agg(concat(role, ': ', content), E'\n' order by id), 500) as context from messages group by 1", ("messages",))
def rolling_contexts(t: Tables) -> DataFrame:
    messages = t.messages.select("session_id", "id", "role", "content")
    return S.latest_updates(arriving(messages, lambda rows: S.rolling_contexts(rows, 500), "update", "x3", "id"), "session_id")


@query("x4_feedback_stream", "select event_id, case when value = lag(value) over (partition by target order by ts, event_id) then 'already_rated' else 'ok' end as result from feedback", ("feedback",))
def feedback_stream(t: Tables) -> DataFrame:
    return arriving(t.feedback, S.feedback_stream, "append", "x4", "ts").select("event_id", "result")


@query("x5_subscription_stream", "select user_id, count(*) % 2 = 1 as is_subscribed, count(*) as toggles from toggles group by 1", ("toggles",))
def subscription_stream(t: Tables) -> DataFrame:
    return S.latest_updates(arriving(t.toggles, S.subscription_stream, "update", "x5", "ts"), "user_id").select("user_id", "is_subscribed", "toggles")


@query("x6_mailing_stream", "select distinct concat('n:', user_id % 50) as recipient_key from events", ("events",))
def mailing_stream(t: Tables) -> DataFrame:
    keyed = t.events.select(F.concat(F.lit("n:"), (F.col("user_id") % 50).cast("string")).alias("recipient_key"), "ts")
    return S.drain(S.mailing_stream(replayed(keyed, "mailing"), within="60 days"), "append", "x6").select("recipient_key")


@query("x7_ingest_stream", "select distinct doc_id from documents where trim(text) <> ''", ("documents",))
def ingest_stream(t: Tables) -> DataFrame:
    twice = t.documents.select("doc_id", "text").unionByName(t.documents.select("doc_id", "text").where("doc_id % 4 = 0"))
    store = S.ingest_stream(replayed(twice, "documents"), Store(t.spark, fresh_path(t.spark, "store")))
    return store.read("chunks").groupBy("doc_id", "chunk_order_index").count().where("count = 1").select("doc_id").distinct()


@query("x7_stored_chunks", f"select e.doc_id, trim(d.text) as content, embedding from ({EMBEDDED_SQL}) e join documents d using (doc_id) where trim(d.text) <> ''", ("documents",), EMBEDDED)
def stored_chunks(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", F.lit("page").alias("source_type"))
    store = Store(t.spark, fresh_path(t.spark, "store"))
    whole = lambda rows: ingest.whole_doc_chunks(rows, ("page",))
    S.ingest_stream(replayed(docs.unionByName(docs.where("doc_id % 4 = 0")), "documents"), store, prepare=whole, encode=lambda rows: ingest.embed(rows, code=ingest.md5_code))
    return store.read("chunks").select("doc_id", "content", "embedding")


@query("x8_trace_states", "select request_id, count(*) as steps, arg_max(phase, step) as phase from traces group by 1", ("traces",))
def trace_states(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "traces")
    rows = t.traces.select("request_id", F.col("ts").cast("timestamp").alias("timestamp"), "step", "phase", "thought", "action", F.lit(None).cast("string").alias("action_input"), "observation")
    io.write_traces(rows, path)
    stream = t.spark.readStream.schema(io.TRACE_SCHEMA + ", day date").option("maxFilesPerTrigger", 20).json(path)
    return S.latest_updates(S.drain(S.trace_states(stream), "update", "x8"), "request_id").select("request_id", "steps", "phase")
