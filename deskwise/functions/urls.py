"""Addresses and keys."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_page(url: str) -> Column:
    """``page:N`` for addresses with pageId=N or attachments/N, else the address without blanks around it."""
    number = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("page:"), F.coalesce(number(r"pageId=(\d+)"), number(r"attachments/(\d+)"))), F.trim(url))


def _normal(url: str | None) -> str:
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        return urlunsplit(("https", parts.netloc.lower().removeprefix("www."), "/" + unquote(parts.path).strip("/"), parts.query, ""))
    except ValueError:
        return url.strip()


@F.pandas_udf(StringType())
def normalize_url(url: pd.Series) -> pd.Series:
    """https, the host in lower case without www., the path decoded, with one slash before it and none after it, the query
    as it is, no fragment. Null and empty addresses are empty; what can't be read stays, without blanks around it."""
    return url.map(_normal)


@F.pandas_udf(StringType())
def _decoded(part: pd.Series) -> pd.Series:
    return part.map(lambda p: p and unquote(p))


def title_from_url(url: str) -> Column:
    """What follows the last slash, but for slashes at the end, without query and .pdf, decoded, dashes and underlines as
    blanks; ``Untitled`` if nothing is left. Only parts with a percent sign leave the JVM."""
    last = F.element_at(F.split(F.rtrim(F.col(url), F.lit("/")), "/"), -1)
    name = F.regexp_replace(F.regexp_replace(last, r"\?.*$", ""), r"(?i)\.pdf$", "")
    words = F.translate(F.when(name.contains("%"), _decoded(name)).otherwise(name), "-_", "  ")
    return F.coalesce(F.nullif(words, F.lit("")), F.lit("Untitled"))


def doc_key(source_type: str, base: str, title: str) -> Column:
    """sha256 of type, base and title; without a base, of type and title."""
    return F.sha2(F.concat_ws(":", F.col(source_type), F.nullif(F.col(base), F.lit("")), F.col(title)), 256)


def doc_id(key: Column) -> Column:
    return F.left(F.sha1(key), F.lit(16))


def chunk_id(text: str) -> Column:
    return F.concat(F.lit("chunk-"), F.md5(F.col(text)))


def route_errors(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """The pages that no rule of :func:`route_url` fits, with ``reason``."""
    reason = F.when(F.coalesce(F.trim(url), F.lit("")) == "", "no address").otherwise(F.concat(F.lit("no rule for "), F.col(url)))
    return pages.where(route_url(url, rules).isNull()).withColumn("reason", reason)


def route_url(url: str, rules: list[tuple[str, str, str]]) -> Column:
    """``source_type, doc_type`` of the first rule (pattern, source type, document type) that the address matches; null
    if there is none."""
    out = F.lit(None).cast("struct<source_type: string, doc_type: string>")
    for pattern, source, kind in reversed(rules):
        out = F.when(F.coalesce(F.col(url).rlike(pattern), F.lit(False)), F.struct(F.lit(source).alias("source_type"), F.lit(kind).alias("doc_type"))).otherwise(out)
    return out
