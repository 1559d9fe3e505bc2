"""Chat, retrieval and task tables derived from the test data by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_T0 = "2024-01-01 00:00:00"
BASE = ("conversations", "events", "embeddings", "documents", "pages", "benchmark")

#: name: (the tables that it reads, its SQL). {T0} is a timestamp without zone in either engine.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "users": (
        ("events",),
        """select user_id as id, case user_id % 3 when 0 then 'telegram' when 1 then 'vk' else 'max' end as platform,
        concat('u', cast(user_id as string)) as platform_user_id,
        case when user_id % 4 = 0 then null else concat('Name', cast(user_id as string)) end as username,
        case when user_id % 5 = 0 then concat('First', cast(user_id as string)) end as first_name,
        case when user_id % 7 = 0 then concat('Last', cast(user_id as string)) end as last_name,
        user_id % 2 = 0 as is_subscribed, min(ts) as created_at from events group by user_id""",
    ),
    "sessions": (
        ("conversations",),
        """select distinct conv_id as id, conv_id % 12 as user_id,
        case when conv_id % 5 = 0 then 'CLOSED' else 'DIALOG' end as state from conversations""",
    ),
    "messages": (
        ("conversations",),
        """select conv_id * 100 + turn as id, conv_id as session_id, role, text as content,
        case when role = 'assistant' then concat('model-', cast(conv_id % 3 as string)) end as model_used,
        {T0} + conv_id * 7 * interval '1' hour + turn * interval '1' minute as created_at
        from conversations where role in ('user', 'assistant')""",
    ),
    "questions_answers": (
        ("messages",),
        """select question_id, answer_id,
        case when question_id % 4 = 0 then 'b' when question_id % 4 = 1 then null else 'a' end as relevance_type,
        case when question_id % 11 = 0 then 'answered' when question_id % 13 = 0 then 'document_added' end as admin_status_override
        from (select id as question_id, lead(id) over (partition by session_id order by id) as answer_id, role,
        lead(role) over (partition by session_id order by id) as next_role from messages) p
        where role = 'user' and next_role = 'assistant'""",
    ),
    "doc_chunks": (
        ("embeddings",),
        """select concat('chunk-', cast(vec_id as string)) as id, case when vec_id % 10 = 9 then 'archive' else 'default' end as workspace,
        vec_id % 50 as full_doc_id, vec_id,
        case vec_id % 3 when 0 then concat('https://kb.example.org/p?pageId=', cast(vec_id % 50 as string))
        when 1 then concat('https://www.example.org/d/', cast(vec_id % 50 as string))
        else concat('file:', cast(vec_id as string)) end as file_path, embedding, label from embeddings""",
    ),
    "used_chunks": (
        ("questions_answers",),
        """select answer_id as message_id, concat('chunk-', cast((answer_id * 3 + k) % 500 as string)) as chunk_id
        from questions_answers cross join (select 0 as k union all select 1 as k) ks where answer_id % 5 < 3""",
    ),
    "docs": (
        ("doc_chunks",),
        """select distinct full_doc_id as id, workspace, case when full_doc_id % 6 = 0 then null else concat('Document ', cast(full_doc_id as string)) end as doc_name
        from doc_chunks""",
    ),
    "answer_links": (
        ("questions_answers",),
        """select answer_id, k as pos, case when (answer_id + k) % 3 = 0 then concat('https://kb.example.org/a/', cast(answer_id as string))
        when (answer_id + k) % 3 = 1 then concat('https://other.example.net/', cast(answer_id as string))
        else concat('note:', cast(answer_id as string)) end as url, concat('Link ', cast(k as string)) as label
        from questions_answers cross join (select 0 as k union all select 1 as k) ks where answer_id % 3 = 0""",
    ),
    "admin_tasks": (
        ("questions_answers",),
        """select question_id + 7 as id, question_id, answer_id,
        case question_id % 4 when 0 then 'added' when 1 then 'in_progress' when 2 then 'on_hold' else 'done' end as status,
        {T0} + question_id * interval '1' minute as created_at, {T0} + question_id * interval '2' minute as updated_at,
        case when question_id % 5 = 0 then {T0} + question_id * interval '3' minute end as archived_at,
        case when question_id % 5 = 0 then question_id % 7 end as report_id
        from questions_answers where question_id % 6 < 3""",
    ),
    "reports": (
        ("admin_tasks",),
        """select report_id as id, max(archived_at) as created_at, count(*) as tasks_count from admin_tasks where report_id is not null group by report_id
        union all select 1000, {T0}, 0""",
    ),
    "vector_queries": (("embeddings",), "select vec_id as query_id, embedding, label from embeddings where vec_id % 20 = 0"),
    "entity_chunks": (
        ("embeddings",),
        """select concat('label-', cast(label as string)) as entity, concat('chunk-', cast(vec_id as string)) as chunk_id from embeddings
        union all select concat('mod-', cast(vec_id % 37 as string)), concat('chunk-', cast(vec_id as string)) from embeddings""",
    ),
    "relation_chunks": (("embeddings",), "select concat('rel-', cast(vec_id % 7 as string)) as entity, concat('chunk-', cast(vec_id as string)) as chunk_id from embeddings"),
    "query_entities": (
        ("vector_queries",),
        """select query_id, concat('label-', cast(label as string)) as entity, 0 as pos from vector_queries
        union all select query_id, concat('mod-', cast(query_id % 37 as string)), 1 from vector_queries""",
    ),
    "query_relations": (("vector_queries",), "select query_id, concat('rel-', cast(query_id % 7 as string)) as entity, 0 as pos from vector_queries"),
    "feedback": (
        ("events",),
        "select event_id, user_id as target, ts, case event_type when 'click' then 'like' else 'dislike' end as value from events where event_type in ('click', 'error')",
    ),
    "toggles": (("events",), "select event_id, user_id, ts from events where event_type = 'signup'"),
    "telemetry": (
        ("events",),
        """select event_id as id, ts, case when event_type = 'error' then 'ERROR' else 'INFO' end as level, concat('newsletter:', cast(user_id % 9 as string), ':', cast(user_id as string)) as request_id,
        case when user_id % 2 = 0 then 'bot' else 'qa' end as service, props as payload from events""",
    ),
    "traces": (
        ("events",),
        """select concat('req-', cast(user_id as string)) as request_id, ts, row_number() over (partition by user_id order by ts, event_id) as step, event_type as phase,
        props as thought, case when event_type = 'click' then 'search' end as action, case when event_type = 'error' then 'failed' end as observation from events""",
    ),
    "holidays": (
        (),
        """select * from (values (1, 'New year', timestamp '2000-01-01 00:00:00', 1, 1), (2, 'Dated', timestamp '2024-01-15 00:00:00', cast(null as int), cast(null as int)),
        (4, 'Second of two', timestamp '2000-01-20 00:00:00', 1, 20), (3, 'First of two', timestamp '2024-01-20 00:00:00', cast(null as int), cast(null as int))) t(id, name, day, month, day_of_month)""",
    ),
}


def needed(names: tuple[str, ...]) -> list[str]:
    """The views that these views read, each after those that it reads itself."""
    out: list[str] = []
    for name in names:
        if name in VIEWS and name not in out:
            out += [x for x in needed(VIEWS[name][0]) if x not in out] + [name]
    return out


def ctes(names: tuple[str, ...], spark_dir: str | None = None) -> str:
    """``with`` clauses for DuckDB, where the base tables are views, or for Spark, which reads them from a folder."""
    order = needed(names)
    base = [b for b in BASE if b in names or any(b in VIEWS[n][0] for n in order)]
    parts = [f"{b} as (select * from parquet.`{spark_dir}/{b}.parquet`)" for b in base] if spark_dir else []
    zero = f"timestamp_ntz '{_T0}'" if spark_dir else f"timestamp '{_T0}'"
    return "with " + ",\n".join(parts + [f"{n} as ({VIEWS[n][1].replace('{T0}', zero)})" for n in order])


class Tables:
    """The tables of one folder: ``Tables(spark, dir).messages``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        return self.spark.sql(f"{ctes((name,), self.sf_dir)} select * from {name}")
