"""Answers, classifications and other text columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rewrites of markdown, in the order in which they have to be applied.
MARKDOWN = (
    (r"```[\s\S]*?```", ""),
    (r"`([^`]+)`", "$1"),
    (r"(?md)^#{1,6}\s+", ""),
    (r"(?d)\*\*(.+?)\*\*", "$1"),
    (r"(?d)(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1"),
    (r"(?md)^\s*[-*+]\s+", ""),
    (r"(?md)^\s*\d+\.\s+", ""),
    (r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)"),
    (r"<(\s*https?://[^>]+)\s*>", "$1"),
    (r"<entity:[^>]*>", ""),
    (r"【\d+†[^】]*】", ""),
    (r"\n{3,}", "\n\n"),
)
#: Those of them that a message gets right before it is sent.
LIGHT = (MARKDOWN[2], MARKDOWN[3], MARKDOWN[5], MARKDOWN[6], MARKDOWN[11])
#: Fixed value: an address, which doesn't end in punctuation.
_URL = r"""https?://[^\s<>\[\](){}"']*[^\s<>\[\](){}"'.,;:!]"""


def strip(text: Column) -> Column:
    """Without any white space around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _rewritten(text: Column, rules) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def clean_markdown(text: str | Column) -> Column:
    return _rewritten(F.col(text) if isinstance(text, str) else text, MARKDOWN)


def strip_markdown_light(text: str | Column) -> Column:
    return _rewritten(F.col(text) if isinstance(text, str) else text, LIGHT)


def _last(text: Column, mark: str) -> Column:
    """How many characters stand before the last ``mark``; -1 if there is none. The mark reads the same backwards."""
    at = F.instr(F.reverse(text), mark)
    return F.when(at == 0, -1).otherwise(F.length(text) - at - len(mark) + 1)


def format_answer(text: str | Column, longest: int = 1500) -> Column:
    """A longer text is cut at its last blank line if that leaves over 70 %, else at its last line end, else where it is
    too long, which is also done if a cut left less than half."""
    text = F.col(text) if isinstance(text, str) else text
    head = F.left(text, F.lit(longest))
    block, line = _last(head, "\n\n"), _last(head, "\n")
    cut = F.when(block > longest * 0.7, block).otherwise(line)
    cut = F.when(cut < longest * 0.5, longest).otherwise(cut)
    return F.when(F.length(text) <= longest, text).otherwise(strip(F.left(text, cut)))


def message_cut(text: str, longest: int = 3900, kept: int = 3850) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(kept)), F.lit("\n\n..."))).otherwise(F.col(text))


def buttons(sources: str, most: int = 3, label: str = "More") -> Column:
    """The first sources (url, label) that have an address."""
    some = F.filter(F.slice(sources, 1, most), lambda s: F.coalesce(s["url"], F.lit("")) != "")
    return F.transform(some, lambda s: F.struct(s["url"].alias("url"), F.coalesce(s["label"], F.lit(label)).alias("label")))


def extract_links(text: str | Column, more: str = "подробнее:", headings: tuple[str, ...] = ("references", "источники")) -> Column:
    """``text, links``: lines that only give sources are taken out, and their addresses listed once each.

    Those are lines that begin with ``more`` or with a number in brackets before an address, whose addresses are kept,
    and lines that begin with one of ``headings``, whose aren't. Angle brackets around addresses go.
    """
    text = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(text, "\n"), strip)
    low = lambda line: F.lower(line)
    heading = lambda line: F.exists(F.array(*map(F.lit, headings)), lambda h: F.startswith(low(line), h))
    source = lambda line: F.startswith(low(line), F.lit(more)) | (~heading(line) & line.rlike(r"^(-\s*)?\[\d+\]\s*https?://"))
    found = F.flatten(F.transform(F.filter(lines, source), lambda line: F.regexp_extract_all(line, F.lit(_URL), 0)))
    rest = F.transform(F.filter(lines, lambda line: ~source(line) & ~heading(line)), lambda line: F.regexp_replace(F.regexp_replace(line, "<(https?://)", "$1"), "(https?://)>", "$1"))
    return F.struct(F.regexp_replace(strip(F.array_join(rest, "\n")), r"\n{3,}", "\n\n").alias("text"), F.array_distinct(found).alias("links"))


#: What goes from a raw answer, in this order.
ANSWER = (
    (r"(?iu)^нет\.\s*", ""),
    (r"^\([^)]*\)\s*", ""),
    (r"\n*[Ии]спользованн?ые?\s+источники:\s*[\d,\s]+\n*", "\n"),
)


def postprocess(text: str, longest: int = 1500) -> Column:
    """``text, links`` of a raw answer: markdown, a leading "no." and bracket, and the line of used sources go, links are
    taken out, and what is left is cut."""
    out = clean_markdown(text)
    for pattern, instead in ANSWER:
        out = F.regexp_replace(out, pattern, instead)
    split = extract_links(strip(out))
    return F.struct(format_answer(split["text"], longest).alias("text"), split["links"].alias("links"))


_ANSWER = T.StructType([T.StructField("relevant_sources", T.ArrayType(T.IntegerType())), T.StructField("answer", T.StringType()), T.StructField("stage", T.StringType())])


def _numbers(value) -> list[int]:
    return [int(x) for x in value if isinstance(x, int | str) and str(x).isdigit()] if isinstance(value, list) else []


def _balanced(text: str) -> str | None:
    """The first object in braces, quotes considered; None if it isn't closed."""
    start = text.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if skip:
            skip = False
        elif c == "\\":
            skip = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def parse_answer(raw: str | None) -> dict | None:
    """The answer and its source numbers: from an object, from ``key: value`` lines, from an object that was cut off, or
    from an ``answer`` field anywhere; else the text itself is the answer. ``stage`` tells which."""
    if raw is None:
        return None
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", raw)
    if body := _balanced(text):
        try:
            value = json.loads(body)
        except ValueError:
            value = None
        if isinstance(value, dict) and value:
            answer = value.get("answer")
            return {"relevant_sources": _numbers(value.get("relevant_sources", [])), "answer": answer if isinstance(answer, str) and answer.strip() else raw, "stage": "json"}
    if not text.lstrip().startswith("{") and (m := re.search(r"(?ims)^\s*answer\s*:\s*(.+)", text)):
        numbers = re.search(r"(?im)^\s*relevant_sources\s*:\s*\[([^\]]*)\]", text)
        return {"relevant_sources": [int(x) for x in re.findall(r"\d+", numbers[1])] if numbers else [], "answer": m[1].strip().strip('"').strip(), "stage": "lines"}
    if (start := text.find("{")) >= 0:
        cut = text[start:].rstrip().rstrip(",")
        for tail in ("}", '"}', "]}", '"]}'):
            try:
                value = json.loads(cut + tail)
            except ValueError:
                continue
            if isinstance(value, dict) and isinstance(value.get("answer"), str) and value["answer"].strip():
                return {"relevant_sources": _numbers(value.get("relevant_sources", [])), "answer": value["answer"], "stage": "repaired"}
    if m := re.search(r'"answer"\s*:\s*"((?:[^"\\]|\\.)*)', text):
        return {"relevant_sources": [], "answer": m[1].replace('\\"', '"').replace("\\n", "\n"), "stage": "field"}
    return {"relevant_sources": [], "answer": raw, "stage": "text"}


@F.pandas_udf(_ANSWER)
def _parsed_slowly(raw: pd.Series) -> pd.DataFrame:
    rows = [parse_answer(r) or {"relevant_sources": None, "answer": None, "stage": None} for r in raw]
    return pd.DataFrame(rows, columns=["relevant_sources", "answer", "stage"])


def parse_llm_json(raw: str) -> Column:
    """``relevant_sources, answer, stage``. A clean object of plain fields is read by Spark; only other rows go through
    the Python ladder of :func:`parse_answer`. Answers lose their markdown."""
    text = F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    plain = text.rlike(r'^\s*\{\s*"relevant_sources"\s*:\s*\[[\d,\s]*\]\s*,\s*"answer"\s*:\s*"(?:[^"\\]|\\.)*\S(?:[^"\\]|\\.)*"\s*\}\s*$')
    read = F.from_json(F.when(plain, text), "relevant_sources array<int>, answer string")
    fast = F.when(read["answer"].isNotNull(), F.struct(read["relevant_sources"].alias("relevant_sources"), read["answer"].alias("answer"), F.lit("json").alias("stage")))
    slow = _parsed_slowly(F.when(read["answer"].isNull(), F.col(raw)))
    out = F.coalesce(fast, slow)
    return F.struct(out["relevant_sources"].alias("relevant_sources"), clean_markdown(out["answer"]).alias("answer"), out["stage"].alias("stage"))


def parse_classification(raw: str, original: str, longest: int = 1500) -> Column:
    """``question_type, expanded_query, confidence, context_expanded_query`` of the first object without nesting.

    The type is 1 unless it is the number 1, 2 or 3; blank queries fall back to the original one, or to null for the
    context's; confidence is 0.5 unless it's a number.
    """
    body = F.nullif(F.regexp_extract(raw, r"(?s)\{[^{}]*\}", 0), F.lit(""))
    value = F.try_parse_json(body)
    field = lambda name, kind: F.try_variant_get(value, f"$.{name}", kind)
    kind_of = lambda name: F.schema_of_variant(F.variant_get(value, f"$.{name}", "variant"))
    number = F.when(kind_of("type") == "BIGINT", field("type", "int"))
    query = F.when(kind_of("expanded_query") == "STRING", field("expanded_query", "string"))
    context = F.when(kind_of("context_expanded_query") == "STRING", field("context_expanded_query", "string"))
    sure = F.when(kind_of("confidence").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), field("confidence", "double"))
    some = lambda c: F.when(strip(c) != "", c)
    return F.struct(
        F.when(number.isin(1, 2, 3), number).otherwise(1).alias("question_type"),
        F.when(value.isNull(), F.col(original)).otherwise(strip(F.left(F.coalesce(some(query), F.col(original)), F.lit(longest)))).alias("expanded_query"),
        F.coalesce(sure, F.lit(0.5)).alias("confidence"),
        strip(F.left(some(context), F.lit(longest))).alias("context_expanded_query"),
    )


def keywords(metadata: str) -> Column:
    """``high_level, low_level`` of a JSON object's keywords; empty arrays for what is missing."""
    read = F.from_json(metadata, "keywords struct<high_level: array<string>, low_level: array<string>>")["keywords"]
    none = F.array().cast("array<string>")
    return F.struct(*(F.coalesce(read[k], none).alias(k) for k in ("high_level", "low_level")))


#: The node that each intent leads to.
NODES = {"kb_qa": "kb_workflow", "meta": "meta", "tool_required": "react", "clarify": "clarify", "off_topic": "off_topic"}


def intent_node(intent: str | Column) -> Column:
    out = F.lit("end")
    column = F.col(intent) if isinstance(intent, str) else intent
    for name, node in NODES.items():
        out = F.when(column == name, node).otherwise(out)
    return out


def parse_intent(raw: str) -> Column:
    """``intent, complexity`` of a JSON object; kb_qa and simple if it can't be read."""
    read = F.from_json(raw, "intent string, complexity string")
    intent = F.when(F.json_array_length(F.concat(F.lit("["), F.col(raw), F.lit("]"))).isNotNull(), read["intent"]).otherwise("kb_qa")
    return F.struct(intent.alias("intent"), F.coalesce(read["complexity"], F.lit("simple")).alias("complexity"))


def safe_json_array(text: str, element: str = "struct<url: string, label: string>") -> Column:
    """The array, or an empty one for null, broken or other JSON."""
    array = F.when(F.json_array_length(text).isNotNull(), F.from_json(text, f"array<{element}>"))
    return F.coalesce(array, F.array().cast(f"array<{element}>"))


def newsletter_key(kind: str, day: str) -> Column:
    return F.concat_ws(":", F.lit("newsletter"), F.col(kind), F.date_format(day, "yyyy-MM-dd"))


def recipient_key(key: str | Column, platform: str, user: str) -> Column:
    return F.concat_ws(":", F.col(key) if isinstance(key, str) else key, F.col(platform), F.col(user).cast("string"))


def display_name(username: str, sender: str) -> Column:
    return F.coalesce(F.nullif(F.col(username), F.lit("")), F.nullif(F.col(sender), F.lit("")))


def answer_events(intent: str, complexity: str, error: str, answer: str, sources: str) -> Column:
    """An answer as its ordered events (event, data): start, thoughts, error, token, sources, done."""
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.cast("string").alias("data"))
    thought = F.to_json(F.struct(F.lit("classification").alias("type"), F.coalesce(intent, F.lit("unknown")).alias("intent"), F.coalesce(complexity, F.lit("simple")).alias("complexity")))
    acts = F.when(F.col(intent) == "kb_qa", event("thought", F.lit("search"))).when(F.col(intent) == "tool_required", event("thought", F.lit("tool")))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    head = F.array(event("event", F.lit("agent_start")), event("thought", thought), acts, F.when(filled(error), event("error", F.col(error))), F.when(filled(answer), event("token", F.col(answer))))
    listed = F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.struct(F.lit("source").alias("event"), s.alias("data")))
    return F.concat(F.filter(head, lambda e: e.isNotNull()), listed, F.array(event("done", F.lit("{}"))))


def clean_ocr_text(text: str) -> Column:
    """Without control characters, runs of blanks after letters and digits, and blank lines."""
    out = F.regexp_replace(text, "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    out = F.regexp_replace(out, r"([а-яёА-ЯЁa-zA-Z0-9])\s{2,}", "$1 ")
    return F.array_join(F.filter(F.transform(F.split(out, r"\r\n|\n|\r"), strip), lambda line: line != ""), "\n")
