"""State changes as jobs: a snapshot and a table of commands give the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskwise.operators.search import containing


def latest(commands: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The last command of each key; of equal times the one with the greatest row."""
    rest = [c for c in commands.columns if c != key]
    return commands.groupBy(key).agg(F.max(F.struct(ts, *(c for c in rest if c != ts))).alias("_c")).select(key, *(f"_c.{c}" for c in rest))


def mark_answered(qa: DataFrame, tasks: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """False positives (question_id): their override is ``answered`` and their open tasks go."""
    ids = commands.select("question_id").distinct()
    marked = qa.join(ids.withColumn("_m", F.lit(True)), "question_id", "left")
    qa = marked.withColumn("admin_status_override", F.when(F.col("_m"), "answered").otherwise(F.col("admin_status_override"))).drop("_m")
    return qa, tasks.where("archived_at is null").join(ids, "question_id", "left_anti").unionByName(tasks.where("archived_at is not null"))


def create_tasks(tasks: DataFrame, qa: DataFrame, commands: DataFrame) -> DataFrame:
    """Adds a task ``added`` for each commanded question (question_id, ts) that has none."""
    new = latest(commands, "question_id").join(qa.select("question_id", "answer_id").dropDuplicates(["question_id"]), "question_id").join(tasks.select("question_id"), "question_id", "left_anti")
    row = {"id": F.xxhash64("question_id"), "status": F.lit("added"), "created_at": F.col("ts"), "updated_at": F.col("ts")}
    made = new.withColumns({c: row.get(c, F.lit(None)) if c not in new.columns else F.col(c) for c in tasks.columns})
    return tasks.unionByName(made.select(*(F.col(f.name).cast(f.dataType) for f in tasks.schema)))


def set_task_status(qa: DataFrame, tasks: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets open tasks (question_id, status, ts). ``done`` adds the document; another status only takes that back."""
    change = latest(commands, "question_id").select("question_id", F.col("status").alias("_to"), F.col("ts").alias("_at"))
    joined = tasks.join(change, "question_id", "left")
    open_ = F.col("archived_at").isNull() & F.col("_to").isNotNull()
    moved = joined.withColumns({"status": F.when(open_, F.col("_to")).otherwise(F.col("status")), "updated_at": F.when(open_, F.col("_at")).otherwise(F.col("updated_at"))})
    hit = joined.where(open_).select("question_id", "_to").dropDuplicates(["question_id"])
    override = F.col("admin_status_override")
    qa = qa.join(hit, "question_id", "left").withColumn("admin_status_override", F.when(F.col("_to") == "done", "document_added").when(F.col("_to").isNotNull() & (override == "document_added"), None).otherwise(override)).drop("_to")
    return qa, moved.select(*tasks.columns)


def delete_tasks(qa: DataFrame, tasks: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open tasks (question_id) go, and with them an override ``document_added``."""
    ids = commands.select("question_id").distinct()
    gone = tasks.where("archived_at is null").join(ids, "question_id", "left_semi").select("question_id").distinct().withColumn("_g", F.lit(True))
    override = F.col("admin_status_override")
    qa = qa.join(gone, "question_id", "left").withColumn("admin_status_override", F.when(F.col("_g") & (override == "document_added"), None).otherwise(override)).drop("_g")
    kept = tasks.join(gone, "question_id", "left").where("archived_at is not null or _g is null").drop("_g")
    return qa, kept.select(*tasks.columns)


def build_report(qa: DataFrame, tasks: DataFrame, sources: DataFrame, report_id: int, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``report, items, qa, tasks``: the open tasks that are done become a report's items with their sources and are
    archived; without any the report has no row."""
    done = tasks.where("archived_at is null and status = 'done'")
    items = done.join(sources, "answer_id", "left").select(F.lit(report_id).cast("long").alias("report_id"), F.col("id").alias("task_id"), "question_id", "answer_id", "created_at", "sources", F.lit(None).cast("timestamp").alias("restored_at"))
    report = done.agg(F.count("*").alias("tasks_count")).where("tasks_count > 0").select(F.lit(report_id).cast("long").alias("id"), now.alias("created_at"), "tasks_count")
    is_done = F.col("archived_at").isNull() & (F.col("status") == "done")
    archived = tasks.withColumns({"_d": is_done}).withColumns({"archived_at": F.when(F.col("_d"), now).otherwise(F.col("archived_at")), "report_id": F.when(F.col("_d"), F.lit(report_id)).otherwise(F.col("report_id"))}).drop("_d")
    hit = done.select("question_id").distinct().withColumn("_h", F.lit(True))
    qa = qa.join(hit, "question_id", "left").withColumn("admin_status_override", F.when(F.col("_h"), "document_added").otherwise(F.col("admin_status_override"))).drop("_h")
    return report, items, qa, archived


def restore_items(qa: DataFrame, tasks: DataFrame, items: DataFrame, commands: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``qa, tasks, items``: report items (task_id) back to work. An item that was restored stays as it is; a task that
    is there is opened again as ``added``, a missing one is made; the override goes and the item is stamped once."""
    asked = items.where("restored_at is null").join(commands.select("task_id").distinct(), "task_id", "left_semi")
    back = asked.select(F.col("task_id").alias("id"), "question_id", "answer_id").dropDuplicates(["id"])
    ids = back.select("id", F.lit(True).alias("_b"))
    opened = tasks.join(ids, "id", "left").withColumns({"status": F.when(F.col("_b"), "added").otherwise(F.col("status")), "archived_at": F.when(F.col("_b"), None).otherwise(F.col("archived_at")), "report_id": F.when(F.col("_b"), None).otherwise(F.col("report_id")), "updated_at": F.when(F.col("_b"), now).otherwise(F.col("updated_at"))})
    row = {"status": F.lit("added"), "created_at": now, "updated_at": now}
    missing = back.join(tasks.select("id"), "id", "left_anti")
    made = missing.withColumns({c: row.get(c, F.lit(None)) for c in tasks.columns if c not in back.columns}).select(*(F.col(f.name).cast(f.dataType) for f in tasks.schema))
    hit = asked.select("question_id").distinct().withColumn("_h", F.lit(True))
    qa = qa.join(hit, "question_id", "left").withColumn("admin_status_override", F.when(F.col("_h"), None).otherwise(F.col("admin_status_override"))).drop("_h")
    stamp = items.join(commands.select("task_id").distinct().withColumn("_s", F.lit(True)), "task_id", "left")
    return qa, opened.select(*tasks.columns).unionByName(made), stamp.withColumn("restored_at", F.when(F.col("_s"), F.coalesce("restored_at", now)).otherwise(F.col("restored_at"))).drop("_s")


def upsert_users(users: DataFrame, seen: DataFrame, fields: tuple[str, ...] = ("username", "first_name", "last_name")) -> DataFrame:
    """Users by (platform, platform_user_id): new ones are added, filled fields replace what is stored."""
    key = ["platform", "platform_user_id"]
    new = latest_by(seen, key).select(*key, *(F.col(f).alias(f"_{f}") for f in fields))
    both = users.join(new, key, "full_outer")
    both = both.withColumns({f: F.coalesce(F.nullif(F.col(f"_{f}"), F.lit("")), F.col(f)) for f in fields})
    return both.withColumn("id", F.coalesce("id", F.xxhash64(*key))).select(*users.columns)


def latest_by(rows: DataFrame, key: list[str], ts: str = "ts") -> DataFrame:
    rest = [c for c in rows.columns if c not in key and c != ts]
    return rows.groupBy(*key).agg(F.max(F.struct(ts, *rest)).alias("_c")).select(*key, f"_c.{ts}", *(f"_c.{c}" for c in rest))


ACTIVE = ("START", "DIALOG", "WAITING_ANSWER")


def new_dialogs(sessions: DataFrame, commands: DataFrame) -> DataFrame:
    """Closes the active sessions of each commanded user (user_id) and opens one."""
    users = commands.select("user_id").distinct()
    closing = sessions.join(users.withColumn("_c", F.lit(True)), "user_id", "left")
    closed = closing.withColumn("state", F.when(F.col("_c") & F.col("state").isin(*ACTIVE), "CLOSED").otherwise(F.col("state"))).select("id", "user_id", "state")
    start = sessions.agg(F.coalesce(F.max("id"), F.lit(-1).cast("long")).alias("m"))
    opened = users.crossJoin(F.broadcast(start)).select((F.col("m") + 1 + F.col("user_id")).alias("id"), "user_id", F.lit("DIALOG").alias("state"))
    return closed.unionByName(opened)


def backfill_overrides(qa: DataFrame, tasks: DataFrame) -> DataFrame:
    """Done tasks without an override of their question add the document."""
    done = tasks.where("status = 'done'").select("question_id").distinct().withColumn("_d", F.lit(True))
    return qa.join(done, "question_id", "left").withColumn("admin_status_override", F.coalesce("admin_status_override", F.when(F.col("_d"), "document_added"))).drop("_d")


def pairs(messages: DataFrame) -> DataFrame:
    """``session_id, question_id, answer_id, touched``: a user's message and the assistant's next one."""
    order = Window.partitionBy("session_id").orderBy("id")
    ahead = messages.select("session_id", "id", "role", F.lead("id").over(order).alias("answer_id"), F.lead("role").over(order).alias("_next"), F.max("created_at").over(Window.partitionBy("session_id")).alias("touched"))
    return ahead.where("role = 'user' and _next = 'assistant'").select("session_id", F.col("id").alias("question_id"), "answer_id", "touched")


def active_session(sessions: DataFrame) -> DataFrame:
    """``user_id, session_id``: the latest session of each user that isn't closed."""
    return sessions.where("state <> 'CLOSED'").groupBy("user_id").agg(F.max("id").alias("session_id"))


def last_answer(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """``user_id, session_id, message_id``: what feedback is about, the last answer of each active session."""
    answers = messages.where("role = 'assistant'").groupBy("session_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("message_id"))
    return active_session(sessions).join(answers, "session_id").select("user_id", "session_id", "message_id")


def dialog_context(messages: DataFrame, n_pairs: int = 3, chars: int = 300, names: tuple[str, str] = ("User", "Assistant")) -> DataFrame:
    """``id, context`` of every message: the 2 n_pairs messages before it, oldest first, the last ``chars`` characters.
    A message without content is its role alone."""
    line = F.concat(F.when(F.col("role") == "user", names[0]).otherwise(names[1]), F.lit(": "), F.coalesce("content", F.lit("")))
    before = Window.partitionBy("session_id").orderBy("id").rowsBetween(-2 * n_pairs, -1)
    return messages.select("id", F.right(F.array_join(F.collect_list(line).over(before), "\n"), F.lit(chars)).alias("context"))


def chat_context(turns: DataFrame) -> DataFrame:
    """``conv_id, context``: the turns before the last user's turn, without system turns."""
    last = turns.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last"))
    before = turns.join(last, "conv_id").where("turn < last and role <> 'system'")
    line = F.concat(F.initcap("role"), F.lit(": "), "text")
    return before.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def rolling_context(messages: DataFrame, chars: int = 2000) -> DataFrame:
    """``id, context``: after each message, the last ``chars`` characters of its session.

    A running length says which messages reach into those characters, and only these are held for a message.
    """
    line = F.concat(F.col("role"), F.lit(": "), F.right("content", F.lit(chars)))
    so_far = F.sum(F.length(line) + 1).over(Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    rows = messages.select("session_id", "id", line.alias("line"), so_far.alias("so_far"))
    seen = Window.partitionBy("session_id").orderBy("so_far").rangeBetween(-chars - 1, 0)
    return rows.select("id", F.right(F.array_join(F.collect_list("line").over(seen), "\n"), F.lit(chars)).alias("context"))


def trace_timeline(traces: DataFrame) -> DataFrame:
    """Adds ``gap``, the seconds since the step before of the same request."""
    before = F.lag("ts").over(Window.partitionBy("request_id").orderBy("ts", "step"))
    return traces.withColumn("gap", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6)


def holiday_on(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """``day, holiday_id, name``: the holiday of least id of each day (day), by its month and day or by its date."""
    days = days.select("day", F.month("day").alias("m"), F.dayofmonth("day").alias("d"))
    recurring = holidays.where("month is not null").select(F.col("month").alias("m"), F.col("day_of_month").alias("d"), "id", "name")
    dated = holidays.where("month is null").select(F.month("day").alias("m"), F.dayofmonth("day").alias("d"), "id", "name")
    both = days.join(recurring.unionByName(dated), ["m", "d"])
    return both.groupBy("day").agg(F.min("id").alias("holiday_id"), F.min_by("name", "id").alias("name"))


def subscribers(users: DataFrame, platforms: tuple[str, ...] = ("telegram", "vk", "max")) -> DataFrame:
    """Subscribed users with ``skipped`` where their platform has no delivery."""
    return users.where(F.col("is_subscribed")).withColumn("skipped", ~F.col("platform").isin(*platforms))


def pending(recipients: DataFrame, delivered: DataFrame) -> DataFrame:
    """Recipients whose key isn't among those delivered."""
    return recipients.join(delivered.select("recipient_key"), "recipient_key", "left_anti")


def delivery_summary(deliveries: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return deliveries.groupBy("newsletter_key").agg(of("sent"), of("skipped"), of("failed"))


def telemetry_on(logs: DataFrame, day: str, service: str, level: str, text: str) -> DataFrame:
    start = F.lit(day).cast("timestamp_ntz")
    return logs.where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("interval 1 day")) & (F.col("service") == service) & (F.col("level") == level) & F.col("payload").ilike(f"%{text}%"))


def block_search(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, block_id``: blocks (block_id, title, text) that hold a query's text, in any case and without blanks around it;
    all of them if none does. Null and blank queries ask for all.

    Equal texts are sought once, by :func:`search.containing`; there may be any number of queries.
    """
    low = queries.select("query_id", F.lower(F.btrim("query", F.lit(" \t\n\r\f\v"))).alias("needle"))
    needles = low.where("needle <> ''").select("needle").distinct().withColumn("needle_id", F.col("needle"))
    found = containing(blocks.select("block_id", F.lower("title").alias("title"), F.lower("text").alias("text")), needles, texts=("title", "text"))
    hits = low.join(found, F.col("needle") == F.col("needle_id")).select("query_id", "block_id")
    none = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    return hits.unionByName(none.crossJoin(blocks.select("block_id")))


def feedback_results(feedback: DataFrame) -> DataFrame:
    """Adds ``result``: ``error`` without a target, ``already_rated`` for the value that stands, else ``ok``."""
    before = F.lag("value").over(Window.partitionBy("target").orderBy("ts", "event_id"))
    return feedback.withColumn("result", F.when(F.col("target").isNull(), "error").when(F.col("value") == before, "already_rated").otherwise("ok"))


def subscription_intervals(toggles: DataFrame) -> DataFrame:
    """``user_id, subscribed_at, unsubscribed_at``: each odd toggle begins an interval, which the next one ends."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = toggles.select("user_id", F.col("ts").alias("subscribed_at"), F.lead("ts").over(order).alias("unsubscribed_at"), F.row_number().over(order).alias("_k"))
    return rows.where("_k % 2 = 1").drop("_k")
