"""Conversation analytics on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.operators import analytics as A
from deskwise.plans.registry import query
from deskwise.sources.tables import Tables

HOST, PHRASE = "kb.example.org", "no information"

ALL = ("users", "sessions", "messages", "questions_answers", "admin_tasks", "used_chunks", "doc_chunks", "docs", "answer_links", "reports")
FACTS = {
    "facts": """select q.question_id, q.answer_id, q.relevance_type, q.admin_status_override, m.content as question, m.session_id, m.created_at,
        a.content as answer, a.model_used, s.user_id, u.platform, u.username, t.id as task_id, t.status as task_status
        from questions_answers q join messages m on m.id = q.question_id left join messages a on a.id = q.answer_id
        join sessions s on s.id = m.session_id join users u on u.id = s.user_id left join admin_tasks t on t.question_id = q.question_id and t.archived_at is null""",
    "foreign_answers": f"""select message_id as answer_id from used_chunks join doc_chunks d on d.id = chunk_id where file_path ilike 'http%' and not file_path ilike '%{HOST}%'
        union select answer_id from answer_links where url ilike 'http%' and not url ilike '%{HOST}%'""",
    "stated": f"""select facts.*, case when coalesce(admin_status_override, '') = '' and relevance_type is null then 'no_status'
        when coalesce(admin_status_override, '') not in ('answered', 'document_added') and (relevance_type = 'b' or relevance_type is null and answer ilike '%{PHRASE}%') then 'unanswered'
        when coalesce(admin_status_override, '') not in ('answered', 'document_added') and coalesce(relevance_type, '') <> 'b' and answer_id in (select answer_id from foreign_answers) then 'not_official'
        when admin_status_override = 'document_added' then 'document_added' else 'answered' end as status from facts""",
    "sourced": """select q.answer_id, coalesce(c.s, l.s, []) as sources from questions_answers q
        left join (select message_id as answer_id, list({'url': file_path, 'label': coalesce(doc_name, file_path)} order by d.id) as s from used_chunks join doc_chunks d on d.id = chunk_id
          left join docs on docs.id = d.full_doc_id and docs.workspace = d.workspace group by message_id) c using (answer_id)
        left join (select answer_id, list({'url': url, 'label': label} order by pos) as s from answer_links where url ilike 'http%' group by answer_id) l using (answer_id)""",
}


def facts(t: Tables) -> DataFrame:
    return A.qa_facts(t.questions_answers, t.messages, t.sessions, t.users, t.admin_tasks)


def stated(t: Tables) -> DataFrame:
    return A.with_status(facts(t), A.foreign_sources(t.used_chunks, t.doc_chunks, t.answer_links, HOST), PHRASE)


def sourced(t: Tables) -> DataFrame:
    return A.answer_sources(t.questions_answers, t.used_chunks, t.doc_chunks, t.docs, t.answer_links)


@query("p2_status_counts", "select status, count(*) as n from stated group by status", ALL, FACTS)
def status_counts(t: Tables) -> DataFrame:
    return stated(t).groupBy("status").agg(F.count("*").alias("n"))


@query("j1_qa_facts", "select question_id, answer_id, user_id, platform, task_id, task_status, length(answer) as answer_length from facts", ALL, FACTS)
def qa_facts(t: Tables) -> DataFrame:
    return facts(t).select("question_id", "answer_id", "user_id", "platform", "task_id", "task_status", F.length("answer").cast("long").alias("answer_length"))


@query("p1_qa_filter", "select question_id, platform, status from stated where platform = 'vk' and created_at >= timestamp '2024-01-03' and created_at <= timestamp '2024-01-25' and (question ilike '%th_n%' or answer ilike '%th_n%')", ALL, FACTS)
def qa_filter(t: Tables) -> DataFrame:
    return A.qa_filter(stated(t), "vk", "2024-01-03", "2024-01-25", "th_n").select("question_id", "platform", "status")


@query("p2_filter_unanswered", "select question_id, relevance_type, admin_status_override from stated where status = 'unanswered'", ALL, FACTS)
def filter_unanswered(t: Tables) -> DataFrame:
    return A.qa_filter(stated(t), status="unanswered").select("question_id", "relevance_type", "admin_status_override")


@query("p2_filter_not_official", "select question_id, relevance_type, admin_status_override from stated where status = 'not_official'", ALL, FACTS)
def filter_not_official(t: Tables) -> DataFrame:
    return A.qa_filter(stated(t), status="not_official").select("question_id", "relevance_type", "admin_status_override")


@query("j2_foreign_answers", "select answer_id from foreign_answers", ALL, FACTS)
def foreign_answers(t: Tables) -> DataFrame:
    return A.foreign_sources(t.used_chunks, t.doc_chunks, t.answer_links, HOST)


@query(
    "j3_foreign_flags",
    f"""select answer_id, exists (select 1 from answer_links l where l.answer_id = q.answer_id and url ilike 'http%' and not url ilike '%{HOST}%')
    or exists (select 1 from used_chunks u join doc_chunks d on d.id = u.chunk_id where u.message_id = q.answer_id and file_path ilike 'http%' and not file_path ilike '%{HOST}%') as is_foreign from questions_answers q""",
    ("questions_answers", "used_chunks", "doc_chunks", "answer_links"),
)
def foreign_flags(t: Tables) -> DataFrame:
    answers = t.questions_answers.select("answer_id").join(A.link_lists(t.answer_links), "answer_id", "left")
    return A.foreign_flags(answers, t.used_chunks, t.doc_chunks, HOST)


@query("g5_source_lists", "select answer_id, list(url order by pos) as urls from answer_links where url ilike 'http%' group by 1", ("answer_links",))
def source_lists(t: Tables) -> DataFrame:
    return A.link_lists(t.answer_links)


@query(
    "j5_user_statistics",
    "select u.id, count(m.id) as questions from users u left join sessions s on s.user_id = u.id left join messages m on m.session_id = s.id and m.role = 'user' group by 1",
    ("users", "sessions", "messages"),
)
def user_statistics(t: Tables) -> DataFrame:
    return A.user_activity(t.users, t.sessions, t.messages).select("id", "questions")


@query("p4_host_filter", f"select id, file_path from doc_chunks where file_path ilike 'http%' and not file_path ilike '%{HOST}%'", ("doc_chunks",))
def host_filter(t: Tables) -> DataFrame:
    return t.doc_chunks.where(A.foreign("file_path", HOST)).select("id", "file_path")


@query("j4_answer_sources", "select answer_id, to_json(sources)::varchar as sources from sourced", ALL, FACTS)
def answer_sources(t: Tables) -> DataFrame:
    return sourced(t).select("answer_id", F.to_json("sources").alias("sources"))


@query(
    "g1_overview",
    """select (select count(*) from users) as users, count(*) as questions, count(*) filter (created_at::date = n::date) as questions_today,
    count(*) filter (created_at >= n - interval 30 days) as questions_30d, count(distinct user_id) filter (created_at >= n - interval 30 days) as active_users_30d,
    (select count(*) from stated where status = 'unanswered') as unanswered, (select count(*) from stated where status = 'not_official') as not_official
    from messages m join sessions s on s.id = m.session_id cross join (select max(created_at) as n from messages) where role = 'user'""",
    ALL,
    FACTS,
)
def overview(t: Tables) -> DataFrame:
    return A.overview(t.messages, t.users, t.sessions, stated(t))


@query("g2_users_by_platform", "select platform, count(*) as users, round(count(*) * 100.0 / sum(count(*)) over (), 0)::int as share from users group by platform", ("users",))
def users_by_platform(t: Tables) -> DataFrame:
    return A.users_by_platform(t.users)


def _series(period: str):
    @query(f"g3_timeseries_{period}", f"select date_trunc('{period}', created_at)::timestamp as bucket, count(*) as questions from messages where role = 'user' group by 1", ("messages",))
    def timeseries(t: Tables) -> DataFrame:
        return A.timeseries(t.messages.where("role = 'user'"), period).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "questions")


for _period in ("day", "week", "month", "year"):
    _series(_period)


@query(
    "g4_user_activity",
    """select id, platform, coalesce(questions, 0) as questions, last_activity from users left join
    (select user_id, count(*) as questions, max(m.created_at) as last_activity from messages m join sessions s on s.id = m.session_id where role = 'user' group by 1) on user_id = id""",
    ("users", "sessions", "messages"),
)
def user_activity(t: Tables) -> DataFrame:
    return A.user_activity(t.users, t.sessions, t.messages).select("id", "platform", "questions", "last_activity")


@query("p3_user_filter", "select id from users where username ilike '%me1%' or first_name ilike '%me1%' or last_name ilike '%me1%' or platform_user_id ilike '%me1%'", ("users",))
def user_filter(t: Tables) -> DataFrame:
    return A.user_filter(t.users, "me1").select("id")


@query(
    "t2_active_users",
    """select id, questions, last_activity from users join (select user_id, count(*) as questions, max(m.created_at) as last_activity from messages m
    join sessions s on s.id = m.session_id where role = 'user' group by 1) on user_id = id union all
    select id, 0, null from users where id not in (select s.user_id from sessions s join messages m on m.session_id = s.id where role = 'user') order by last_activity desc nulls last, id desc limit 20""",
    ("users", "sessions", "messages"),
)
def active_users(t: Tables) -> DataFrame:
    rows = A.user_activity(t.users, t.sessions, t.messages).select("id", "questions", "last_activity")
    return A.page(rows, 1, 20, F.col("last_activity").desc_nulls_last(), F.col("id").desc())


@query("t1_qa_page", "select question_id, status, total from (select *, count(*) over () as total from stated) order by created_at desc, question_id desc limit 20 offset 20", ALL, FACTS)
def qa_page(t: Tables) -> DataFrame:
    rows = stated(t).select("question_id", "status", "created_at")
    total = rows.agg(F.count("*").alias("total"))
    return A.page(rows, 2, 20, F.col("created_at").desc(), F.col("question_id").desc()).crossJoin(total).select("question_id", "status", "total")


@query(
    "g6_report_items",
    """select r.id, r.created_at, tasks_count, to_json(coalesce(list({'question_id': question_id, 'status': status} order by t.created_at desc, t.id desc) filter (t.id is not null), []))::varchar as items
    from reports r left join admin_tasks t on t.report_id = r.id group by 1, 2, 3""",
    ("reports", "admin_tasks"),
)
def report_items(t: Tables) -> DataFrame:
    return A.report_items(t.reports, t.admin_tasks).withColumn("items", F.to_json("items"))


@query("t4_newest_reports", "select id, created_at from reports order by created_at desc, id desc limit 3 offset 1", ("reports",))
def newest_reports(t: Tables) -> DataFrame:
    return t.reports.select("id", "created_at").orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(1).limit(3)


@query("g7_tasks_by_status", "select status, count(*) as tasks from admin_tasks group by status", ("admin_tasks",))
def tasks_by_status(t: Tables) -> DataFrame:
    return A.task_counts(t.admin_tasks, "status")


@query("g7_tasks_by_report", "select report_id, count(*) as tasks from admin_tasks group by report_id", ("admin_tasks",))
def tasks_by_report(t: Tables) -> DataFrame:
    return A.task_counts(t.admin_tasks, "report_id")


@query(
    "m10_task_list",
    """select t.id, t.question_id, t.status, s.status as qa_status, s.answer_id, to_json(sources)::varchar as sources,
    case t.status when 'added' then 0 when 'in_progress' then 1 when 'on_hold' then 2 when 'done' then 3 else 4 end as rank
    from admin_tasks t join stated s on s.question_id = t.question_id left join sourced x on x.answer_id = s.answer_id where archived_at is null""",
    ALL,
    FACTS,
)
def task_list(t: Tables) -> DataFrame:
    return A.task_list(t.admin_tasks, stated(t), sourced(t)).select("id", "question_id", "status", "qa_status", "answer_id", F.to_json("sources").alias("sources"), "rank")


@query(
    "t3_tasks_by_rank",
    "select id, status from admin_tasks order by case status when 'added' then 0 when 'in_progress' then 1 when 'on_hold' then 2 when 'done' then 3 else 4 end, updated_at desc, id limit 15",
    ("admin_tasks",),
)
def tasks_by_rank(t: Tables) -> DataFrame:
    return t.admin_tasks.orderBy(A.status_rank(), F.col("updated_at").desc(), "id").limit(15).select("id", "status")
