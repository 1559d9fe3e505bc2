"""Conversation analytics: questions with their statuses and sources, overview, users, tasks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINAL = ("answered", "document_added")


def qa_facts(qa: DataFrame, messages: DataFrame, sessions: DataFrame, users: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row for each question: its answer, user and open task, where there are any."""
    question = messages.select(F.col("id").alias("question_id"), F.col("content").alias("question"), "session_id", "created_at")
    answer = messages.select(F.col("id").alias("answer_id"), F.col("content").alias("answer"), "model_used")
    who = users.select(F.col("id").alias("user_id"), "platform", "username")
    session = sessions.select(F.col("id").alias("session_id"), "user_id")
    task = tasks.where("archived_at is null").select("question_id", F.col("id").alias("task_id"), F.col("status").alias("task_status"))
    facts = qa.join(question, "question_id").join(answer, "answer_id", "left").join(session, "session_id").join(who, "user_id")
    return facts.join(task, "question_id", "left")


def foreign(url: str | Column, host: str) -> Column:
    """An http address that isn't on the official host."""
    url = F.col(url) if isinstance(url, str) else url
    return url.ilike("http%") & ~url.ilike(f"%{host}%")


def foreign_sources(used: DataFrame, chunks: DataFrame, links: DataFrame, host: str) -> DataFrame:
    """``answer_id`` of the answers with a chunk or a link off the official host."""
    by_chunk = used.join(chunks.where(foreign("file_path", host)).select(F.col("id").alias("chunk_id")), "chunk_id").select(F.col("message_id").alias("answer_id"))
    return by_chunk.unionByName(links.where(foreign("url", host)).select("answer_id")).distinct()


def with_status(facts: DataFrame, foreign_answers: DataFrame, phrase: str) -> DataFrame:
    """Adds ``status``: no_status, unanswered, not_official, document_added or answered; exactly one holds."""
    flagged = facts.join(foreign_answers.withColumn("_foreign", F.lit(True)), "answer_id", "left")
    override, kind = F.coalesce("admin_status_override", F.lit("")), F.col("relevance_type")
    none = (override == "") & kind.isNull()
    open_ = ~override.isin(*FINAL) & ~none
    said_no = (kind == "b") | (kind.isNull() & F.coalesce(F.col("answer").ilike(f"%{phrase}%"), F.lit(False)))
    status = F.when(none, "no_status").when(open_ & said_no, "unanswered")
    status = status.when(open_ & (F.coalesce(kind, F.lit("")) != "b") & F.col("_foreign"), "not_official")
    return flagged.withColumn("status", status.when(override == "document_added", "document_added").otherwise("answered")).drop("_foreign")


def qa_filter(facts: DataFrame, platform: str | None = None, date_from=None, date_to=None, search: str | None = None, status: str | None = None) -> DataFrame:
    """Only the conditions that are given; days are inclusive, wildcards in the search term are active."""
    if platform is not None:
        facts = facts.where(F.col("platform") == platform)
    if date_from is not None:
        facts = facts.where(F.col("created_at") >= F.lit(date_from))
    if date_to is not None:
        facts = facts.where(F.col("created_at") <= F.lit(date_to))
    if search is not None:
        facts = facts.where(F.col("question").ilike(f"%{search}%") | F.col("answer").ilike(f"%{search}%"))
    return facts if status is None else facts.where(F.col("status") == status)


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page of 1 to 200 rows in the given order, the total order being the caller's."""
    size = min(max(size, 1), 200)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def answer_sources(answers: DataFrame, used: DataFrame, chunks: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """``answer_id, sources``: the chunks' sources by chunk id, else the http links in order, else an empty array."""
    named = chunks.select(F.col("id").alias("chunk_id"), "workspace", F.col("full_doc_id").alias("doc_id"), "file_path").join(docs.select(F.col("id").alias("doc_id"), "workspace", "doc_name"), ["doc_id", "workspace"], "left")
    source = F.struct("chunk_id", F.struct(F.col("file_path").alias("url"), F.coalesce("doc_name", "file_path").alias("label")).alias("s"))
    by_chunk = used.join(named, "chunk_id").groupBy(F.col("message_id").alias("answer_id")).agg(F.array_sort(F.collect_list(source)).alias("c"))
    link = F.struct("pos", F.struct("url", "label").alias("s"))
    by_link = links.where(F.col("url").ilike("http%")).groupBy("answer_id").agg(F.array_sort(F.collect_list(link)).alias("l"))
    only = lambda c: F.transform(c, lambda x: x["s"])
    joined = answers.select("answer_id").join(by_chunk, "answer_id", "left").join(by_link, "answer_id", "left")
    return joined.select("answer_id", F.coalesce(only("c"), only("l"), F.slice(F.array(F.struct(F.lit("").alias("url"), F.lit("").alias("label"))), 1, 0)).alias("sources"))


def foreign_flags(answers: DataFrame, used: DataFrame, chunks: DataFrame, host: str) -> DataFrame:
    """``answer_id, is_foreign`` of each answer (answer_id, urls): whether one of its own links (an array), or the path
    of a chunk that it used, leads to another host. The chunks' flag is aggregated before it is joined."""
    by_chunk = used.join(chunks.select(F.col("id").alias("chunk_id"), "file_path"), "chunk_id").where(foreign("file_path", host))
    flagged = by_chunk.select(F.col("message_id").alias("answer_id"), F.lit(True).alias("_f")).distinct()
    own = F.exists(F.coalesce("urls", F.array().cast("array<string>")), lambda u: u.ilike("http%") & ~u.ilike(f"%{host}%"))
    return answers.join(flagged, "answer_id", "left").select("answer_id", (F.coalesce(own, F.lit(False)) | F.coalesce("_f", F.lit(False))).alias("is_foreign"))


def link_lists(links: DataFrame) -> DataFrame:
    """``answer_id, urls``: the http links of each answer (answer_id, pos, url) in their order."""
    some = links.where(F.col("url").ilike("http%")).groupBy("answer_id")
    return some.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("urls"))


def overview(messages: DataFrame, users: DataFrame, sessions: DataFrame, facts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row of totals: users, questions, those of the day and of the 30 days up to ``as_of``, open statuses.

    ``as_of`` is by default the last message's time. Two scans: the messages with their users, and the facts.
    """
    asked = messages.where("role = 'user'").join(sessions.select(F.col("id").alias("session_id"), "user_id"), "session_id")
    now = messages.agg(F.max("created_at").alias("now")) if as_of is None else messages.sparkSession.range(1).select(as_of.alias("now"))
    recent = F.col("created_at") >= F.col("now") - F.expr("interval 30 days")
    today = F.to_date("created_at") == F.to_date("now")
    counts = asked.crossJoin(F.broadcast(now)).agg(
        F.count("*").alias("questions"), F.count_if(today).alias("questions_today"), F.count_if(recent).alias("questions_30d"), F.countDistinct(F.when(recent, F.col("user_id"))).alias("active_users_30d")
    )
    states = facts.agg(F.count_if(F.col("status") == "unanswered").alias("unanswered"), F.count_if(F.col("status") == "not_official").alias("not_official"))
    return users.agg(F.count("*").alias("users")).crossJoin(counts).crossJoin(states)


def users_by_platform(users: DataFrame) -> DataFrame:
    counts = users.groupBy("platform").agg(F.count("*").alias("users"))
    return counts.withColumn("share", F.round(F.col("users") * 100.0 / F.sum("users").over(Window.partitionBy()), 0).cast("int"))


def timeseries(questions: DataFrame, period: str, since: Column | None = None, platform: str | None = None) -> DataFrame:
    """``bucket, questions`` by day, week (from Monday), month or year; empty buckets have no row."""
    if since is not None:
        questions = questions.where(F.col("created_at") >= since)
    if platform is not None:
        questions = questions.where(F.col("platform") == platform)
    return questions.groupBy(F.date_trunc(period, "created_at").alias("bucket")).agg(F.count("*").alias("questions"))


def user_activity(users: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Users with their number of questions and last activity; 0 and null without any."""
    asked = messages.where("role = 'user'").join(sessions.select(F.col("id").alias("session_id"), "user_id"), "session_id")
    stats = asked.groupBy("user_id").agg(F.count("*").alias("questions"), F.max("created_at").alias("last_activity"))
    joined = users.join(stats, users["id"] == stats["user_id"], "left").drop("user_id")
    return joined.withColumn("questions", F.coalesce("questions", F.lit(0).cast("long")))


def user_filter(users: DataFrame, search: str) -> DataFrame:
    named = [F.coalesce(F.col(c).ilike(f"%{search}%"), F.lit(False)) for c in ("username", "first_name", "last_name", "platform_user_id")]
    return users.where(named[0] | named[1] | named[2] | named[3])


def report_items(reports: DataFrame, tasks: DataFrame) -> DataFrame:
    """``id, items``: each report's tasks, newest first; an empty array without any."""
    item = F.struct(F.col("created_at"), F.col("id"), F.struct("question_id", "status").alias("item"))
    lists = tasks.where("report_id is not null").groupBy("report_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("t"))
    joined = reports.select("id", "created_at", "tasks_count").join(lists, reports["id"] == lists["report_id"], "left")
    none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("question_id"), F.lit("").alias("status"))), 1, 0)
    return joined.select("id", "created_at", "tasks_count", F.coalesce(F.transform("t", lambda x: x["item"]), none).alias("items"))


def task_counts(tasks: DataFrame, by: str) -> DataFrame:
    return tasks.groupBy(by).agg(F.count("*").alias("tasks"))


STATUS_RANK = {"added": 0, "in_progress": 1, "on_hold": 2, "done": 3}


def status_rank(column: str = "status") -> Column:
    out = F.lit(len(STATUS_RANK))
    for status, rank in STATUS_RANK.items():
        out = F.when(F.col(column) == status, rank).otherwise(out)
    return out


def task_list(tasks: DataFrame, facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Open tasks with question, answer, status and sources, for the order of :func:`status_rank` and newest update."""
    open_ = tasks.where("archived_at is null").select("id", "question_id", "status", "updated_at")
    fact = facts.select("question_id", "answer_id", "question", "answer", F.col("status").alias("qa_status"))
    return open_.join(fact, "question_id").join(sources, "answer_id", "left").withColumn("rank", status_rank())
