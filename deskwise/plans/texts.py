"""Text functions on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.functions import text as X
from deskwise.functions import urls as U
from deskwise.plans.registry import query
from deskwise.sources.tables import Tables

MARKED = "select doc_id, concat('## Title', chr(10), '* **', source, '** and `', lang, '`', chr(10), '1. ', text, chr(10), chr(10), chr(10), '[1] https://h.example.org/', cast(doc_id as string), chr(10), 'References', chr(10), 'See <https://x.example.org/a>') as t from documents"
LIGHT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#{1,6}\s+', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '(?m)^\s*\d+\.\s+', '', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n\t')"


#: The rewrites of markdown for DuckDB. Its expressions have no look-around, so single asterisks are matched with the
#: characters around them, which is the same where two such spans don't touch.
CLEAN = "{}"
for _pattern, _by in (
    (r"```[\s\S]*?```", ""), (r"`([^`]+)`", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"(^|[^*])\*([^*\n]+?)\*([^*]|$)", r"\1\2\3"), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""),
    (r"\[([^\]]+)\]\(([^)]+)\)", r"\1 (\2)"), (r"<(\s*https?://[^>]+)\s*>", r"\1"), (r"<entity:[^>]*>", ""), (r"【\d+†[^】]*】", ""), (r"\n{3,}", "\n\n"),
):
    CLEAN = f"regexp_replace({CLEAN}, '{_pattern.replace('{', '{{').replace('}', '}}')}', '{_by}', 'g')"
CLEAN = f"trim({CLEAN}, E' \\n\\t\\r')"


def marked(t: Tables) -> DataFrame:
    return t.spark.sql(MARKED.replace("from documents", "from {documents}"), documents=t.documents)


@query("f1_clean_markdown", f"select doc_id, {CLEAN.format('t')} as text from marked", ("documents",), {"marked": MARKED})
def clean_markdown(t: Tables) -> DataFrame:
    return marked(t).select("doc_id", X.clean_markdown("t").alias("text"))


@query("f2_strip_markdown_light", f"select doc_id, {LIGHT} as text from marked", ("documents",), {"marked": MARKED})
def strip_markdown_light(t: Tables) -> DataFrame:
    return marked(t).select("doc_id", X.strip_markdown_light("t").alias("text"))


@query(
    "f3_format_answer",
    r"""select doc_id, case when length(text) <= 1500 then text else trim(text[:case when c < 750 then 1500 else c end], E' \n\t') end as text from (select *, case when b > 1050 then b else l end as c from
    (select doc_id, text, case when instr(reverse(text[:1500]), E'\n\n') = 0 then -1 else length(text[:1500]) - instr(reverse(text[:1500]), E'\n\n') - 1 end as b,
    case when instr(reverse(text[:1500]), E'\n') = 0 then -1 else length(text[:1500]) - instr(reverse(text[:1500]), E'\n') end as l from documents))""",
    ("documents",),
)
def format_answer(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.format_answer("text").alias("text"))


@query("f4_message_cut", r"select doc_id, case when length(text) > 3900 then concat(text[:3850], E'\n\n...') else text end as text from documents", ("documents",))
def message_cut(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.message_cut("text").alias("text"))


@query("f5_extract_links", "select doc_id, [concat('https://h.example.org/', doc_id)] as links from documents", ("documents",))
def extract_links(t: Tables) -> DataFrame:
    return marked(t).select("doc_id", X.extract_links("t")["links"].alias("links"))


@query("f6_postprocess")
def postprocess(t: Tables) -> DataFrame:
    return marked(t).select("doc_id", X.postprocess("t").alias("p")).select("doc_id", "p.*")


RAW = """select conv_id * 100 + turn as id, text, case (conv_id + turn) % 5 when 0 then concat('{"type": ', cast(1 + conv_id % 4 as string), ', "expanded_query": "q ', cast(conv_id as string), '", "confidence": 0.25}')
    when 1 then concat('so: {"type": "2", "expanded_query": " ", "context_expanded_query": "c', cast(turn as string), '"} end') when 2 then 'no object' when 3 then '{"type": 3}' else '{broken' end as raw from conversations"""


@query(
    "f8_parse_classification",
    """select id, case when raw like '{"type": %' and json_valid(raw) and (raw->>'type') in ('1', '2', '3') then (raw->>'type')::int else 1 end as question_type,
    case when raw like '{"type"%' and (raw->>'expanded_query') is not null then raw->>'expanded_query' when raw like '%{%}%' then trim(text[:1500], E' \\n\\t') else text end as expanded_query,
    case when raw like '%0.25%' then 0.25 else 0.5 end::double as confidence, case when raw like 'so:%' then regexp_extract(raw, 'c\\d+') end as context_expanded_query from raws""",
    ("conversations",),
    {"raws": RAW},
)
def parse_classification(t: Tables) -> DataFrame:
    rows = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", _raw().alias("raw"))
    return rows.select("id", X.parse_classification("raw", "text").alias("c")).select("id", "c.*")


def _raw():
    kind, conv, turn = (F.col("conv_id") + F.col("turn")) % 5, F.col("conv_id"), F.col("turn")
    text = F.when(kind == 0, F.concat(F.lit('{"type": '), (1 + conv % 4).cast("string"), F.lit(', "expanded_query": "q '), conv.cast("string"), F.lit('", "confidence": 0.25}')))
    text = text.when(kind == 1, F.concat(F.lit('so: {"type": "2", "expanded_query": " ", "context_expanded_query": "c'), turn.cast("string"), F.lit('"} end')))
    return text.when(kind == 2, "no object").when(kind == 3, '{"type": 3}').otherwise("{broken")


ANSWERS = """select conv_id * 100 + turn as id, turn % 4 as kind, conv_id, case turn % 4 when 0 then concat('**a** ', conv_id) when 1 then concat('cut ', conv_id) when 2 then 'plain' else text end as said from conversations"""


@query(
    "f7_parse_llm_json",
    f"""select id, case kind when 0 then [1, 3] when 1 then [2, 5] when 2 then [4] else [] end::int[] as relevant_sources, {CLEAN.format("said")} as answer,
    case kind when 0 then 'json' when 1 then 'repaired' when 2 then 'lines' else 'text' end as stage from answers""",
    ("conversations",),
    {"answers": ANSWERS},
)
def parse_llm_json(t: Tables) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    raw = F.when(turn % 4 == 0, F.concat(F.lit('{"relevant_sources": [1, 3], "answer": "**a** '), conv.cast("string"), F.lit('"}')))
    raw = raw.when(turn % 4 == 1, F.concat(F.lit("```json\n{\"relevant_sources\": [\"2\", 5], \"answer\": \"cut "), conv.cast("string"))).when(turn % 4 == 2, F.lit("relevant_sources: [4]\nanswer: \"plain\"")).otherwise(F.col("text"))
    rows = t.conversations.select((conv * 100 + turn).alias("id"), raw.alias("raw"))
    return rows.select("id", X.parse_llm_json("raw").alias("p")).select("id", "p.*")


@query("f9_keywords", "select event_id, case when event_id % 3 = 0 then ['a', event_type] else [] end as high_level, case when event_id % 3 = 0 then ['b'] else [] end as low_level from events", ("events",))
def keywords(t: Tables) -> DataFrame:
    data = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"keywords": {"high_level": ["a", "'), "event_type", F.lit('"], "low_level": ["b"]}}'))).when(F.col("event_id") % 3 == 1, F.lit("{bad"))
    return t.events.withColumn("m", data).select("event_id", X.keywords("m").alias("k")).select("event_id", "k.*")


@query(
    "f10_intent_routes",
    "select node, count(*) as n from (select case event_type when 'signup' then 'meta' when 'error' then 'kb_workflow' when 'click' then 'kb_workflow' when 'view' then 'react' else 'end' end as node from events) group by 1",
    ("events",),
)
def intent_routes(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "signup", '{"intent": "meta"}').when(kind == "error", "{broken").when(kind == "click", '{"intent": "kb_qa", "complexity": "complex"}').when(kind == "view", '{"intent": "tool_required"}').otherwise('{"intent": null}')
    rows = t.events.withColumn("raw", raw)
    return rows.groupBy(X.intent_node(X.parse_intent("raw")["intent"]).alias("node")).agg(F.count("*").alias("n"))


@query("f11_safe_json_array", "select event_id, case when event_id % 4 = 0 then 2 else 0 end as n from events", ("events",))
def safe_json_array(t: Tables) -> DataFrame:
    text = F.expr("case event_id % 4 when 0 then '[{\"url\": \"u\", \"label\": \"l\"}, {\"url\": \"v\"}]' when 1 then '{\"url\": 1}' when 2 then '[broken' end")
    return t.events.withColumn("j", text).select("event_id", F.size(X.safe_json_array("j")).alias("n"))


@query("f12_mailing_keys", "select event_id, concat('newsletter:', event_type, ':', strftime(ts, '%Y-%m-%d')) as key, concat('newsletter:', event_type, ':', strftime(ts, '%Y-%m-%d'), ':', 'vk', ':', user_id) as recipient from events", ("events",))
def mailing_keys(t: Tables) -> DataFrame:
    rows = t.events.withColumns({"platform": F.lit("vk"), "key": X.newsletter_key("event_type", "ts")})
    return rows.select("event_id", "key", X.recipient_key("key", "platform", "user_id").alias("recipient"))


@query("f13_display_name", "select id, coalesce(nullif(username, ''), nullif(first_name, '')) as name from users", ("users",))
def display_name(t: Tables) -> DataFrame:
    return t.users.select("id", X.display_name("username", "first_name").alias("name"))


@query("f14_date_parts", "select event_id, date_trunc('day', ts)::timestamp as day, month(ts)::int as month, day(ts)::int as day_of_month, date_trunc('day', ts)::timestamp + interval 1 day as day_end from events", ("events",))
def date_parts(t: Tables) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return t.events.select("event_id", day.alias("day"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day_of_month"), (day + F.expr("interval 1 day")).alias("day_end"))


@query(
    "f16_answer_events",
    """select event_id, generate_subscripts(e, 1) - 1 as pos, unnest(e) as event from (select event_id, list_concat(['event', 'thought'], case when event_type in ('click', 'view') then ['thought'] else [] end, case when event_type = 'error' then ['error'] else [] end,
    case when event_id % 2 = 0 then ['token'] else [] end, case when event_id % 5 = 0 then ['source', 'source'] else [] end, ['done']) as e from events)""",
    ("events",),
)
def answer_events(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id",
        F.expr("case event_type when 'click' then 'kb_qa' when 'view' then 'tool_required' else 'meta' end").alias("intent"),
        F.lit(None).cast("string").alias("complexity"),
        F.expr("case when event_type = 'error' then 'failed' end").alias("error"),
        F.expr("case when event_id % 2 = 0 then 'text' end").alias("answer"),
        F.expr("case when event_id % 5 = 0 then array('s1', 's2') end").alias("sources"),
    )
    events = rows.select("event_id", F.posexplode(X.answer_events("intent", "complexity", "error", "answer", "sources")).alias("pos", "e"))
    return events.select("event_id", F.col("pos").cast("long").alias("pos"), "e.event")


@query(
    "i10_clean_ocr_text",
    r"""select doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(concat(text, chr(7), '  x', chr(10), chr(10), chr(10), ' y '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g'), '([а-яёА-ЯЁa-zA-Z0-9])\s{2,}', '\1 ', 'g'), E'\n'), lambda x: trim(x, E' \t\r')), lambda x: x <> ''), E'\n') as text from documents""",
    ("documents",),
)
def clean_ocr_text(t: Tables) -> DataFrame:
    dirty = F.concat("text", F.lit("\x07  x\n\n\n y "))
    return t.documents.withColumn("t", dirty).select("doc_id", X.clean_ocr_text("t").alias("text"))


@query("i11_title_from_url", r"select page_id, coalesce(nullif(translate(url_decode(regexp_replace(regexp_replace(string_split(rtrim(url, '/'), '/')[-1], '\?.*$', ''), '(?i)\.pdf$', '')), '-_', '  '), ''), 'Untitled') as title from pages", ("pages",))
def title_from_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.title_from_url("url").alias("title"))


@query(
    "i16_normalize_url",
    r"""select page_id, case when coalesce(url, '') = '' then '' else concat('https://', regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', ''), '/', p, case when q <> '' then concat('?', q) else '' end) end as url
    from (select *, trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') as p, regexp_extract(url, '\?([^#]*)', 1) as q from pages)""",
    ("pages",),
)
def normalize_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.normalize_url("url").alias("url"))


@query(
    "i18_keys",
    "select doc_id, sha256(concat_ws(':', lang, case when doc_id % 2 = 0 then source end, text[:20])) as key, sha1(sha256(concat_ws(':', lang, case when doc_id % 2 = 0 then source end, text[:20])))[:16] as id, concat('chunk-', md5(text)) as chunk_id from documents",
    ("documents",),
)
def keys(t: Tables) -> DataFrame:
    rows = t.documents.withColumns({"base": F.expr("case when doc_id % 2 = 0 then source else '' end"), "title": F.left("text", F.lit(20))})
    key = U.doc_key("lang", "base", "title")
    return rows.select("doc_id", key.alias("key"), U.doc_id(key).alias("id"), U.chunk_id("text").alias("chunk_id"))


ROUTES = [(r"\.pdf([?#]|$)", "file", "pdf"), (r"pageId=", "wiki", "page"), (r"example\.com/", "site", "page"), (r"example\.org/.*\.html", "site", "article")]


@query(
    "i15_route_url",
    "select page_id, case when url like '%pageId=%' then 'wiki' when url like '%example.com/%' then 'site' when regexp_matches(url, 'example\\.org/.*\\.html') then 'site' end as source_type, case when url like '%example.com/%' then 'page' when regexp_matches(url, 'example\\.org/.*\\.html') then 'article' end as doc_type from pages",
    ("pages",),
)
def route_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.route_url("url", ROUTES).alias("r")).select("page_id", "r.source_type", "r.doc_type")


@query("i15_route_errors", "select page_id, concat('no rule for ', url) as reason from pages where not url like '%pageId=%' and not url like '%example.com/%' and not regexp_matches(url, 'example\\.org/.*\\.html') and not regexp_matches(url, '\\.pdf([?#]|$)')", ("pages",))
def route_errors(t: Tables) -> DataFrame:
    return U.route_errors(t.pages, ROUTES).select("page_id", "reason")


@query("p5_path_patterns", "select page_id from pages where regexp_matches(url, '/(en|fr)/') and not regexp_matches(url, '[?&]page=')", ("pages",))
def path_patterns(t: Tables) -> DataFrame:
    return t.pages.where(F.col("url").rlike("/(en|fr)/") & ~F.col("url").rlike("[?&]page=")).select("page_id")
