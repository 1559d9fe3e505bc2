"""The stateful operators on streams; each has a batch form in :mod:`deskwise.operators.state` or nearby."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from deskwise.operators import ingest
from deskwise.sources.shared import fresh_path
from deskwise.sources.versions import Store


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str, name: str, path: str | None = None, reports: list | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote.

    Output that is only added goes to Parquet files; updates are kept with their batch number, and the caller picks the
    last ones. A batch that runs again after a failure replaces what it wrote. Checkpoint and output are in the shared
    folder; with ``path`` a stream goes on where an earlier run of that path ended, and what all runs wrote is returned.
    State is in RocksDB, on disk beside the tasks. ``reports`` gets the progress of each batch.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, f"stream-{name}")
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.outputMode("append").format("parquet").option("path", f"{path}/out")
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/out/_batch={number}"))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        query = writer.start()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    query.awaitTermination()
    if reports is not None:
        reports.extend(query.recentProgress)
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    # Folders that begin with an underscore are hidden unless they name a partition, as these do.
    return spark.read.schema(schema).parquet(f"{path}/out")


def questions_per_window(events: DataFrame, ts: str = "ts", size: str = "1 day", late: str = "1 day") -> DataFrame:
    """``bucket, questions``: tumbling windows, given out when the watermark has passed them."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", size)).agg(F.count("*").alias("questions")).select(F.col("window.start").alias("bucket"), "questions")


def user_sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``user_id, started_at, ended_at, events`` of each user's activity without a pause of ``gap``."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    sessions = rows.groupBy("user_id", F.session_window("_ts", gap)).agg(F.count("*").alias("events"))
    return sessions.select("user_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "events")


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, time: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, time)


class _Contexts(StatefulProcessor):
    """A session's state is the end of its text; with ``idle`` a timer ends it so long after its last message."""

    def __init__(self, chars: int, idle: int | None):
        self.chars, self.idle = chars, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.text = handle, handle.getValueState("context", "context string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        recent: list[tuple] = []
        last, cut = None, False
        for batch in rows:
            lines = (f"{r}: {'' if pd.isna(c) else c}" for r, c in zip(batch["role"], batch["content"], strict=True))
            recent = sorted([*recent, *zip(batch["id"], lines, strict=True)])
            if self.idle is not None and pd.notna(latest := batch["ms"].max()):
                last = int(latest) if last is None else max(last, int(latest))
            # Lines before those that fill the context are dropped at once, however many messages a session has.
            size, first = 0, len(recent)
            while first and size <= self.chars:
                first -= 1
                size += len(recent[first][1]) + 1
            cut, recent = cut or first > 0, recent[first:]
        text = "\n".join(line for _, line in recent)
        if not cut and self.text.exists():
            text = f"{self.text.get()[0]}\n{text}"
        text = text[-self.chars :]
        self.text.update((text,))
        if last is not None:
            for timer in list(self.handle.listTimers()):
                last = max(last, timer - self.idle)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle)
        yield pd.DataFrame({"session_id": [key[0]], "context": [text]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.text.clear()
        yield pd.DataFrame({"session_id": [key[0]], "context": [None]})

    def close(self) -> None:
        pass


def rolling_contexts(messages: DataFrame, chars: int = 2000, idle: str | None = None, ts: str = "created_at", late: str = "1 hour") -> DataFrame:
    """``session_id, context`` after each batch: the last ``chars`` (at least 1) characters of each session's messages
    (session_id, id, role, content), in the order of id within a batch; a null content is empty.

    With ``idle`` a session whose last message (``ts``) is so long before the watermark ends: its state goes, and it is
    given out once more with a null context. What comes later begins anew.
    """
    if idle is None:
        return _keyed(messages.select("session_id", "id", "role", "content"), "session_id", _Contexts(chars, None), "session_id long, context string", "update", "none")
    at = F.col(ts).cast("timestamp")
    rows = messages.select("session_id", "id", "role", "content", F.unix_millis(at).alias("ms"), at.alias("at")).withWatermark("at", late)
    return _keyed(rows, "session_id", _Contexts(chars, int(pd.Timedelta(idle).total_seconds() * 1000)), "session_id long, context string", "update", "eventtime")


class _Feedback(StatefulProcessor):
    """A target's state is its value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        value = self.value.get()[0] if self.value.exists() else None
        sorted_rows = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for event, now in zip(sorted_rows["event_id"], sorted_rows["value"], strict=True):
            out.append((event, key[0], "already_rated" if now == value else "ok"))
            value = now
        self.value.update((value,))
        yield pd.DataFrame(out, columns=["event_id", "target", "result"])

    def close(self) -> None:
        pass


def feedback_stream(feedback: DataFrame) -> DataFrame:
    """``event_id, target, result`` of each feedback (event_id, target, ts, value): ok, or already_rated if the value
    stands. The state of a target is its value. A batch's rows of one target are sorted in one task, so
    ``maxFilesPerTrigger`` bounds them."""
    rows = feedback.select("event_id", "target", "ts", "value")
    return _keyed(rows, "target", _Feedback(), "event_id long, target long, result string", "append", "none")


class _Toggles(StatefulProcessor):
    """A user's state is the number of toggles and the time of the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("toggles", "toggles long, since long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, since = self.state.get() if self.state.exists() else (0, None)
        for batch in rows:
            n += len(batch)
            if pd.notna(last := batch["since"].max()):
                since = int(last) if since is None else max(since, int(last))
        self.state.update((n, since))
        yield pd.DataFrame({"user_id": [key[0]], "is_subscribed": [n % 2 == 1], "since": [since], "toggles": [n]})

    def close(self) -> None:
        pass


def subscription_stream(toggles: DataFrame) -> DataFrame:
    """``user_id, is_subscribed, since, toggles`` after each batch of toggles (event_id, user_id, ts)."""
    rows = toggles.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("since"))
    found = _keyed(rows, "user_id", _Toggles(), "user_id long, is_subscribed boolean, since long, toggles long", "update", "none")
    return found.withColumn("since", F.timestamp_micros("since"))


def mailing_stream(recipients: DataFrame, ts: str = "ts", within: str = "2 days") -> DataFrame:
    """Recipients whose key wasn't there within the watermark: each key is mailed once."""
    return recipients.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", within).dropDuplicatesWithinWatermark(["recipient_key"]).drop("_ts")


def ingest_stream(documents: DataFrame, store: Store, name: str = "documents", force: bool = False, prepare: Callable[[DataFrame], DataFrame] = ingest.sentence_chunks, encode: Callable[[DataFrame], DataFrame] = ingest.embed) -> Store:
    """Documents (doc_id, text, ...) of a stream that the store hasn't are chunked, embedded and added to it, or with
    ``force`` replace those that it has.

    Each batch is a version of the store, so one that runs again after a failure replaces what it did. A stream of the same
    ``name`` goes on where the last run of it ended.
    """

    def add(batch: DataFrame, number: int) -> None:
        ingest.add_documents(store, batch, f"{name}-{number}", force, prepare=prepare, encode=encode)

    writer = documents.writeStream.foreachBatch(add).option("checkpointLocation", f"{store.path}/checkpoints/{name}").trigger(availableNow=True)
    writer.start().awaitTermination()
    return store


def trace_states(traces: DataFrame) -> DataFrame:
    """``request_id, steps, phase, last`` of each request: how far it has come."""
    return traces.groupBy("request_id").agg(F.count("*").alias("steps"), F.max_by("phase", F.struct("timestamp", "step")).alias("phase"), F.max("timestamp").alias("last"))


def latest_updates(rows: DataFrame, key: str) -> DataFrame:
    """Of what :func:`drain` kept of updates, the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "_batch"))), "_batch").alias("_r")).select(key, "_r.*")
