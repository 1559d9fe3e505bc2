"""State changes, windows and mailing on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskwise.functions import text as X
from deskwise.operators import state as S
from deskwise.plans.analytics import ALL, FACTS, sourced
from deskwise.plans.registry import query
from deskwise.sources.tables import Tables

QT = ("questions_answers", "admin_tasks")


def commands(t: Tables, where: str, *more) -> DataFrame:
    return t.questions_answers.where(where).select("question_id", F.lit("2024-06-01").cast("timestamp_ntz").alias("ts"), *more)


@query("m1_mark_answered", "select question_id, case when question_id % 5 = 2 then 'answered' else admin_status_override end as override from questions_answers", QT)
def mark_answered(t: Tables) -> DataFrame:
    return S.mark_answered(t.questions_answers, t.admin_tasks, commands(t, "question_id % 5 = 2"))[0].select("question_id", F.col("admin_status_override").alias("override"))


@query("m1_tasks_left", "select id, question_id from admin_tasks where archived_at is not null or question_id % 5 <> 2", QT)
def tasks_left(t: Tables) -> DataFrame:
    return S.mark_answered(t.questions_answers, t.admin_tasks, commands(t, "question_id % 5 = 2"))[1].select("id", "question_id")


@query("m2_create_tasks", "select question_id, answer_id, status from admin_tasks union all select question_id, answer_id, 'added' from questions_answers where question_id % 4 = 1 and question_id not in (select question_id from admin_tasks)", QT)
def create_tasks(t: Tables) -> DataFrame:
    return S.create_tasks(t.admin_tasks, t.questions_answers, commands(t, "question_id % 4 = 1")).select("question_id", "answer_id", "status")


def _status(t: Tables) -> tuple[DataFrame, DataFrame]:
    to = F.when(F.col("question_id") % 2 == 0, "done").otherwise("on_hold").alias("status")
    return S.set_task_status(t.questions_answers, t.admin_tasks, commands(t, "question_id % 3 < 2", to))


@query("m3_set_status", "select id, case when archived_at is null and question_id % 3 < 2 then case when question_id % 2 = 0 then 'done' else 'on_hold' end else status end as status from admin_tasks", QT)
def set_status(t: Tables) -> DataFrame:
    return _status(t)[1].select("id", "status")


@query(
    "m3_overrides",
    """select q.question_id, case when t.id is not null and q.question_id % 3 < 2 and q.question_id % 2 = 0 then 'document_added' when t.id is not null and q.question_id % 3 < 2 and admin_status_override = 'document_added' then null else admin_status_override end as override
    from questions_answers q left join admin_tasks t on t.question_id = q.question_id and t.archived_at is null""",
    QT,
)
def status_overrides(t: Tables) -> DataFrame:
    return _status(t)[0].select("question_id", F.col("admin_status_override").alias("override"))


@query("m4_delete_tasks", "select id from admin_tasks where archived_at is not null or question_id % 4 <> 2", QT)
def delete_tasks(t: Tables) -> DataFrame:
    return S.delete_tasks(t.questions_answers, t.admin_tasks, commands(t, "question_id % 4 = 2"))[1].select("id")


@query(
    "m4_overrides",
    "select q.question_id, case when t.id is not null and q.question_id % 4 = 2 and admin_status_override = 'document_added' then null else admin_status_override end as override from questions_answers q left join admin_tasks t on t.question_id = q.question_id and t.archived_at is null",
    QT,
)
def delete_overrides(t: Tables) -> DataFrame:
    return S.delete_tasks(t.questions_answers, t.admin_tasks, commands(t, "question_id % 4 = 2"))[0].select("question_id", F.col("admin_status_override").alias("override"))


def _report(t: Tables):
    return S.build_report(t.questions_answers, t.admin_tasks, sourced(t), 5000, F.lit("2024-12-01").cast("timestamp_ntz"))


@query("m5_report_items", "select t.id as task_id, t.question_id, to_json(sources)::varchar as sources from admin_tasks t left join sourced s on s.answer_id = t.answer_id where archived_at is null and status = 'done'", ALL, FACTS)
def report_items(t: Tables) -> DataFrame:
    return _report(t)[1].select("task_id", "question_id", F.to_json("sources").alias("sources"))


@query("m5_report", "select 5000::bigint as id, count(*) as tasks_count from admin_tasks where archived_at is null and status = 'done' having count(*) > 0", QT)
def report(t: Tables) -> DataFrame:
    return _report(t)[0].select("id", "tasks_count")


@query("m5_archived", "select id, archived_at is not null or status = 'done' as archived from admin_tasks", QT)
def archived(t: Tables) -> DataFrame:
    return _report(t)[3].select("id", F.col("archived_at").isNotNull().alias("archived"))


@query("m6_restore", "select id, case when archived_at is null and status = 'done' and question_id % 2 = 1 then 'added' else status end as status, archived_at is null and (status <> 'done' or question_id % 2 = 1) as open from admin_tasks", QT)
def restore(t: Tables) -> DataFrame:
    _, items, qa, tasks = _report(t)
    some = items.where("question_id % 2 = 1").select("task_id")
    return S.restore_items(qa, tasks, items, some, F.lit("2024-12-02").cast("timestamp_ntz"))[1].select("id", "status", F.col("archived_at").isNull().alias("open"))


@query(
    "m7_upsert_users",
    "select platform, platform_user_id, case when id % 3 = 1 then concat('New', id) else username end as username from users union all select 'vk', concat('x', id), concat('New', id) from users where id % 10 = 0",
    ("users",),
)
def upsert_users(t: Tables) -> DataFrame:
    name = F.concat(F.lit("New"), F.col("id").cast("string"))
    known = t.users.select("platform", "platform_user_id", F.when(F.col("id") % 3 == 1, name).otherwise("").alias("username"), F.lit("").alias("first_name"), F.lit("").alias("last_name"), F.lit(1).alias("ts"))
    new = t.users.where("id % 10 = 0").select(F.lit("vk").alias("platform"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("platform_user_id"), name.alias("username"), F.lit("").alias("first_name"), F.lit("").alias("last_name"), F.lit(1).alias("ts"))
    return S.upsert_users(t.users, known.unionByName(new)).select("platform", "platform_user_id", "username")


@query("m8_new_dialogs", "select id, user_id, case when user_id < 5 and state <> 'CLOSED' then 'CLOSED' else state end as state from sessions union all select (select max(id) from sessions) + 1 + user_id, user_id, 'DIALOG' from (select distinct user_id from sessions where user_id < 5)", ("sessions",))
def new_dialogs(t: Tables) -> DataFrame:
    return S.new_dialogs(t.sessions, t.sessions.where("user_id < 5"))


@query("m9_backfill", "select question_id, coalesce(admin_status_override, case when question_id in (select question_id from admin_tasks where status = 'done') then 'document_added' end) as override from questions_answers", QT)
def backfill(t: Tables) -> DataFrame:
    return S.backfill_overrides(t.questions_answers, t.admin_tasks).select("question_id", F.col("admin_status_override").alias("override"))


@query("m11_pairs", "select session_id, question_id, answer_id, touched from (select session_id, id as question_id, role, lead(id) over w as answer_id, lead(role) over w as next_role, max(created_at) over (partition by session_id) as touched from messages window w as (partition by session_id order by id)) where role = 'user' and next_role = 'assistant'", ("messages",))
def message_pairs(t: Tables) -> DataFrame:
    return S.pairs(t.messages)


@query(
    "w1_dialog_context",
    r"select id, right(coalesce(string_agg(concat(case role when 'user' then 'User' else 'Assistant' end, ': ', content), E'\n') over (partition by session_id order by id rows between 6 preceding and 1 preceding), ''), 300) as context from messages",
    ("messages",),
)
def dialog_context(t: Tables) -> DataFrame:
    return S.dialog_context(t.messages)


@query(
    "w2_chat_context",
    r"select conv_id, string_agg(concat(upper(role[1]), role[2:], ': ', text), E'\n' order by turn) as context from conversations join (select conv_id, max(turn) as last from conversations where role = 'user' group by 1) using (conv_id) where turn < last and role <> 'system' group by 1",
    ("conversations",),
)
def chat_context(t: Tables) -> DataFrame:
    return S.chat_context(t.conversations)


@query("w3_rolling_context", r"select id, right(string_agg(concat(role, ': ', content), E'\n') over (partition by session_id order by id), 2000) as context from messages", ("messages",))
def rolling_context(t: Tables) -> DataFrame:
    return S.rolling_context(t.messages)


@query("w4_active_session", "select user_id, max(id) as session_id from sessions where state <> 'CLOSED' group by 1", ("sessions",))
def active_session(t: Tables) -> DataFrame:
    return S.active_session(t.sessions)


@query("w5_last_answer", "select a.user_id, a.session_id, max(m.id) as message_id from (select user_id, max(id) as session_id from sessions where state <> 'CLOSED' group by 1) a join messages m on m.session_id = a.session_id and role = 'assistant' group by 1, 2", ("sessions", "messages"))
def last_answer(t: Tables) -> DataFrame:
    return S.last_answer(t.sessions, t.messages)


@query("w6_ordinals", "select session_id, id, dense_rank() over (partition by session_id order by role) as role_number, row_number() over (partition by session_id order by id) as number from messages", ("messages",))
def ordinals(t: Tables) -> DataFrame:
    by = Window.partitionBy("session_id")
    return t.messages.select("session_id", "id", F.dense_rank().over(by.orderBy("role")).cast("long").alias("role_number"), F.row_number().over(by.orderBy("id")).cast("long").alias("number"))


@query("w8_trace_timeline", "select request_id, step, phase, epoch_us(ts) / 1e6 - epoch_us(lag(ts) over (partition by request_id order by ts, step)) / 1e6 as gap_s from traces", ("traces",))
def trace_timeline(t: Tables) -> DataFrame:
    rows = S.trace_timeline(t.traces).select("request_id", F.col("step").cast("long").alias("step"), "phase", F.round("gap", 6).alias("gap_s"))
    return rows


@query("p8_holidays", "select day::varchar as day, min(id) as holiday_id, arg_min(name, id) as name from (select distinct ts::date as day from events) d join (select id, name, coalesce(month, month(day)) as m, coalesce(day_of_month, day(day)) as dm from holidays) h on month(d.day) = m and day(d.day) = dm group by 1", ("holidays", "events"))
def holidays(t: Tables) -> DataFrame:
    return S.holiday_on(t.events.select(F.to_date("ts").alias("day")).distinct(), t.holidays).withColumn("day", F.col("day").cast("string"))


@query("p9_subscribers", "select id, platform, platform not in ('telegram', 'vk') as skipped from users where is_subscribed", ("users",))
def subscribers(t: Tables) -> DataFrame:
    return S.subscribers(t.users, ("telegram", "vk")).select("id", "platform", "skipped")


@query("p6_telemetry", "select id, ts from telemetry where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-11' and service = 'bot' and level = 'INFO' and payload ilike '%\"K\"%'", ("telemetry",))
def telemetry(t: Tables) -> DataFrame:
    return S.telemetry_on(t.telemetry, "2024-01-10", "bot", "INFO", '"K"').select("id", "ts")


@query("p7_key_prefix", "select id, request_id from telemetry where starts_with(request_id, 'newsletter:3:')", ("telemetry",))
def key_prefix(t: Tables) -> DataFrame:
    return t.telemetry.where(F.col("request_id").startswith("newsletter:3:")).select("id", "request_id")


@query(
    "p10_block_search",
    "select query_id, block_id from hits union all select q.query_id, d.doc_id from q, documents d where q.query_id not in (select query_id from hits)",
    ("documents",),
    {
        "q": "select query_id, trim(query) as query from (values (1::bigint, 'Licensed under'), (2, ' SRC7 '), (3, 'nowhere to be found'), (4, 'q'), (5, '7'), (6, 'xz'), (7, ' '), (8, 'licensed under')) v(query_id, query)",
        "hits": "select q.query_id, b.doc_id as block_id from q join documents b on query <> '' and (contains(lower(b.text), lower(q.query)) or contains(lower(b.source), lower(q.query)))",
    },
)
def block_search(t: Tables) -> DataFrame:
    queries = t.spark.createDataFrame([(1, "Licensed under"), (2, " SRC7 "), (3, "nowhere to be found"), (4, "q"), (5, "7"), (6, "xz"), (7, " "), (8, "licensed under")], "query_id long, query string")
    return S.block_search(t.documents.select(F.col("doc_id").alias("block_id"), F.col("source").alias("title"), "text"), queries)


@query("j8_pending", "select id from users where is_subscribed and concat('n:', id) not in (select concat('n:', user_id) from events where event_type = 'purchase' and event_id % 7 = 0)", ("users", "events"))
def pending(t: Tables) -> DataFrame:
    recipients = t.users.where("is_subscribed").select("id", F.concat(F.lit("n:"), F.col("id").cast("string")).alias("recipient_key"))
    delivered = t.events.where("event_type = 'purchase' and event_id % 7 = 0").select(F.concat(F.lit("n:"), F.col("user_id").cast("string")).alias("recipient_key"))
    return S.pending(recipients, delivered).select("id")


@query("g14_delivery_summary", "select concat('newsletter:', event_type, ':', strftime(ts, '%Y-%m-%d')) as newsletter_key, count(*) filter (user_id % 3 = 0) as sent, count(*) filter (user_id % 3 = 1) as skipped, count(*) filter (user_id % 3 = 2) as failed from events group by 1", ("events",))
def delivery_summary(t: Tables) -> DataFrame:
    rows = t.events.select(X.newsletter_key("event_type", "ts").alias("newsletter_key"), F.expr("case user_id % 3 when 0 then 'sent' when 1 then 'skipped' else 'failed' end").alias("status"))
    return S.delivery_summary(rows)


@query("u3_set_difference", "select distinct entity from entity_chunks where entity not in (select entity from query_entities)", ("entity_chunks", "query_entities"))
def set_difference(t: Tables) -> DataFrame:
    return t.entity_chunks.select("entity").distinct().join(t.query_entities, "entity", "left_anti")


@query("x4_feedback", "select event_id, case when value = lag(value) over (partition by target order by ts, event_id) then 'already_rated' else 'ok' end as result from feedback", ("feedback",))
def feedback(t: Tables) -> DataFrame:
    return S.feedback_results(t.feedback).select("event_id", "result")


@query("x5_subscriptions", "select user_id, ts as subscribed_at, next as unsubscribed_at from (select user_id, ts, lead(ts) over w as next, row_number() over w as k from toggles window w as (partition by user_id order by ts, event_id)) where k % 2 = 1", ("toggles",))
def subscriptions(t: Tables) -> DataFrame:
    return S.subscription_intervals(t.toggles)


@query("t5_limited_items", "select doc_id from documents order by doc_id limit 50", ("documents",))
def limited_items(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy("doc_id").limit(50)


@query("j14_report_tasks", "select r.id, count(t.id) as n from reports r left join admin_tasks t on t.report_id = r.id group by 1", ("reports", "admin_tasks"))
def report_tasks(t: Tables) -> DataFrame:
    tasks = t.admin_tasks.select("report_id", F.col("id").alias("task_id"))
    reports = t.reports.select("id")
    return reports.join(tasks, reports["id"] == tasks["report_id"], "left").groupBy("id").agg(F.count("task_id").alias("n"))
