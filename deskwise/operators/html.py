"""Documents, items and links from tables of raw pages (url, html), by profile.

Each profile is a small function of one parsed page; Spark deals the pages and explodes what the function lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element, with its children in order; a child that is text is a string."""

    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []

    def walk(self) -> Iterator[Node]:
        """This element and all below, in the order of the page; without recursion, so depth doesn't matter."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *selectors: str) -> Node | None:
        """The first element of the first selector that has one: ``name``, ``.class``, ``#id``, ``name.class`` or
        ``[attribute=value]``."""
        for selector in selectors:
            for node in self.walk():
                if node is not self and node.fits(selector):
                    return node
        return None

    def every(self, selector: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.fits(selector)]

    def fits(self, selector: str) -> bool:
        if selector.startswith("["):
            attribute, _, value = selector[1:-1].partition("=")
            return self.attributes.get(attribute) == value
        name, _, cls = selector.partition(".")
        if name.startswith("#"):
            return self.attributes.get("id") == name[1:]
        return (not name or self.name == name) and (not cls or cls in self.attributes.get("class", "").split())

    def drop(self, gone: Callable[[Node], bool]) -> Node:
        for node in list(self.walk()):
            node.children = [c for c in node.children if isinstance(c, str) or not gone(c)]
        return self

    def strings(self) -> list[str]:
        """The texts below that aren't blank, trimmed."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                if text := node.strip():
                    out.append(text)
            else:
                todo.extend(reversed(node.children))
        return out

    def text(self, between: str = "") -> str:
        return between.join(self.strings())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def _lines(text: str) -> list[str]:
    return [line for part in text.splitlines() if (line := part.strip())]


#: Elements that the site profile leaves out.
CHROME = frozenset(("script", "style", "nav", "header", "footer", "form", "aside", "noscript"))
#: Fixed values of the readable profile: elements and classes that are not content, where the content is looked for, and
#: lines that only menus have.
UNWANTED = frozenset(
    (
        "script", "style", "nav", "footer", "header", "aside",
        "noscript", "iframe", "svg", "form", "button", "input",
        "select", "textarea", "label",
    )
)
UNWANTED_CLASSES = re.compile(
    r"(footer|header|nav|menu|sidebar|chat|comment|social|share|"
    r"cookie|popup|modal|overlay|banner|advert|sponsor|related)",
    re.I,
)
CONTAINERS = (
    "main",
    "[role=main]",
    "article",
    ".content",
    "#content",
    ".post-content",
    ".article-content",
    ".entry-content",
    ".main-content",
    "#main-content",
    ".page-content",
)
MENU = re.compile(
    r"^(главная|новости|контакты|поиск|вход|регистрация|"
    r"личный кабинет|корзина|избранное|о нас|услуги|"
    r"продукты|цены|отзывы|вакансии|партнёрам|eng|"
    r"menu|home|about|contact|search|login|register|cart|shop)$",
    re.I,
)


def generic(url: str, page: Node) -> dict:
    title = t.text() if (t := page.find("title")) else ""
    page.drop(lambda n: n.name in ("script", "style"))
    parts = (p.strip() for line in page.text("\n").splitlines() for p in line.strip().split("  "))
    return {"title": title, "text": "\n".join(p for p in parts if p)}


def main_content(url: str, page: Node) -> dict:
    heading = page.find("h1", "title")
    title = heading.text() if heading else url
    page.drop(lambda n: n.name in CHROME)
    box = page.find("article", ".main__content", ".content", "main", "body") or page
    return {"title": title, "text": "\n".join(_lines(box.text("\n")))}


def readable(url: str, page: Node, max_length: int = 8000) -> dict:
    most = min(max(max_length, 500), 50_000)
    page.drop(lambda n: n.name in UNWANTED or bool(UNWANTED_CLASSES.search(n.attributes.get("class", ""))))
    title = t.text() if (t := page.find("title")) else ""
    box = page.find(*CONTAINERS) or page.find("body") or page
    lines = [x for x in _lines(box.text("\n")) if len(x) >= 3 and not MENU.match(x)]
    body = "\n\n".join(lines)
    if len(body) > most:
        body = body[:most] + "\n\n... (truncated)"
    head = f"# {title}\n\n" if title else ""
    return {"title": title, "text": f"{head}*Source:* [{url}]({url})\n\n{body}"}


def wiki(url: str, page: Node) -> dict:
    page.drop(lambda n: n.name in ("script", "style"))
    title = h.text() if (h := page.find("h1", "title")) else ""
    return {"title": title, "text": " ".join(" ".join((page.find("body") or page).strings()).split())}


def _table(table: Node) -> str:
    rows = [[c for c in r.children if isinstance(c, Node) and c.name in ("td", "th")] for r in table.every("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    headed = any(c.name == "th" for c in rows[0])
    names = [c.text(" ") for c in rows[0]] if headed else []
    out = []
    for row in rows[headed:]:
        cells = [c.text(" ") for c in row]
        if headed:
            told = [f"{names[i]}: {c}" if i < len(names) and names[i] else c for i, c in enumerate(cells) if c and not (i < len(names) and names[i].strip() in ("№", "#", "N"))]
            out.append("; ".join(told))
        else:
            out.append(" | ".join(c for c in cells if c))
    return "\n".join(x for x in out if x)


def tables(url: str, page: Node) -> dict:
    title = t.text() if (t := page.find("title")) else ""
    page.drop(lambda n: n.name in ("script", "style"))
    box = page.find("div.main-content", "div.content", "main", "div.container", "body") or page
    sections = []
    for part in (c for c in box.children if isinstance(c, Node) and c.name == "div"):
        if not (heading := part.find("h2", "h3", "h4")):
            continue
        told = "\n\n".join(x for x in map(_table, part.every("table")) if x)
        text = part.text()
        if told:
            sections.append(f"{heading.text()}\n\n{told}")
        elif len(text) > 20:
            sections.append(f"{heading.text()}\n{text}")
    if not sections:
        told = [x for x in map(_table, box.every("table")) if x]
        paragraphs = [x for p in box.every("p") if len(x := p.text()) > 20]
        sections = ["\n\n".join(x) for x in (told, paragraphs) if x]
    return {"title": title, "text": re.sub(r"\n{3,}", "\n\n", "\n\n".join(sections)).strip()}


PROFILES = {"generic": generic, "site": main_content, "readable": readable, "wiki": wiki, "tables": tables}
_DOCUMENT = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


def documents(pages: DataFrame, profile: str = "generic", **options) -> DataFrame:
    """Adds ``title`` and ``text`` of each page. A null page is an empty one. The wiki profile keeps texts of 50 or more
    characters only."""
    read = PROFILES[profile]

    @F.pandas_udf(_DOCUMENT)
    def extracted(url: pd.Series, html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(u or "", parse(h), **options) for u, h in zip(url, html, strict=True)], columns=["title", "text"])

    out = pages.withColumn("_d", extracted("url", "html")).withColumns({"title": F.col("_d.title"), "text": F.col("_d.text")}).drop("_d")
    return out.where(F.length("text") >= 50) if profile == "wiki" else out


def _listed(pages: DataFrame, read: Callable[[str, Node], list[dict]], fields: tuple[str, ...]) -> DataFrame:
    """A row for each thing that a page lists, with its place ``pos``."""
    kind = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields]))

    @F.pandas_udf(kind)
    def found(url: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([read(u or "", parse(h)) for u, h in zip(url, html, strict=True)])

    rows = pages.select(*(c for c in pages.columns if c != "html"), F.posexplode(found("url", "html")).alias("pos", "_x"))
    return rows.select(*(c for c in rows.columns if c not in ("_x", *fields)), *(F.col(f"_x.{f}").alias(f if f not in pages.columns else f"item_{f}") for f in fields))


def news_items(pages: DataFrame) -> DataFrame:
    """``item_url, title, category, date`` of the articles that a page lists, where an address and a title stand."""

    def read(url: str, page: Node) -> list[dict]:
        boxes = [a for li in page.every("li.news-page__el") for a in li.every("article")] or page.every("article")
        out = []
        for box in boxes:
            link = next((a for a in box.every("a") if a.attributes.get("href")), None)
            title = t.text() if (t := box.find("h1", "h2", "h3", ".title")) else (link.text() if link else "")
            if not link or not title:
                continue
            part = lambda c: n.text() if (n := box.find(c)) else ""  # noqa: E731, B023
            date = " ".join(x for x in (part(".day"), part(".month"), part(".year")) if x) or part("time") or part(".date")
            out.append({"url": urljoin(url, link.attributes["href"]), "title": title, "category": part(".category"), "date": date})
        return out

    return _listed(pages, read, ("url", "title", "category", "date"))


def faq(pages: DataFrame, question: str = "Question", answer: str = "Answer") -> DataFrame:
    """``title, text``: a document for each question with its answer; links as ``text: address``."""

    def told(node: Node | str, url: str) -> str:
        if isinstance(node, str):
            return node.strip()
        if node.name in ("script", "style", "br"):
            return ""
        if node.name == "a":
            return f"{text}: {urljoin(url, node.attributes.get('href', ''))}" if (text := node.text()) else ""
        return "\n".join(x for c in node.children if (x := told(c, url)))

    def read(url: str, page: Node) -> list[dict]:
        out = []
        for item in page.every("li"):
            asked, inner = item.find("a.toggle"), item.find("div.inner")
            if asked and inner and (q := asked.text()) and (a := re.sub(r"\n{3,}", "\n\n", told(inner, url)).strip()):
                out.append({"title": q, "text": f"{question}: {q}\n{answer}: {a}"})
        return out

    return _listed(pages, read, ("title", "text"))


def blocks(pages: DataFrame) -> DataFrame:
    """``title, text``: a document for each titled block; links but mail and telephone as ``name: address``."""

    def read(url: str, page: Node) -> list[dict]:
        out = []
        for box in page.every("section") or page.every("div"):
            if not (heading := box.find("h2", "h3", "h4")) or any(b is not box and b.find("h2", "h3", "h4") is heading for b in box.every(box.name)):
                continue
            links = [f"{a.text()}: {urljoin(url, h)}" for a in box.every("a") if (h := a.attributes.get("href", "")) and a.text() and not h.startswith(("mailto:", "tel:"))]
            body = "\n".join(x for x in box.strings() if x != heading.text())
            if body:
                out.append({"title": heading.text(), "text": "\n".join([body, *links])})
        return out

    return _listed(pages, read, ("title", "text"))


def links(pages: DataFrame, suffix: str | None = None) -> DataFrame:
    """``link``: the absolute addresses of each page's anchors, once each; only those with ``suffix`` in them, if given."""

    def read(url: str, page: Node) -> list[dict]:
        found = (urljoin(url, h) for a in page.every("a") if (h := a.attributes.get("href", "").strip()))
        return [{"link": x} for x in dict.fromkeys(found) if not suffix or suffix in x.lower()]

    return _listed(pages, read, ("link",))


def allowed_links(pages: DataFrame, allowlist: DataFrame | None = None, suffix: str = ".pdf") -> DataFrame:
    """``link``: distinct addresses with the suffix over all pages, of those that the list (link) allows."""
    found = links(pages, suffix).select("link").distinct()
    return found if allowlist is None else found.join(allowlist.select("link"), "link", "left_semi")
