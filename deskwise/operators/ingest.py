"""Pages to chunks: crawling a page table, chunking, embedding, and stores that grow."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskwise.operators.evaluate import numbered
from deskwise.sources import io
from deskwise.sources.shared import bounded, fresh_path, written
from deskwise.sources.versions import Store

#: Where a sentence or an item of a list ends, and blank lines between paragraphs.
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[А-ЯЁA-Z])|(?<=;)\s*\n(?=\s*—)|(?<=:)\s*\n(?=\s*—)")
_PARAGRAPH = re.compile(r"\n\s*\n")
_CHUNK = T.StructType([T.StructField("content", T.StringType()), T.StructField("chunk_order_index", T.LongType()), T.StructField("chars", T.LongType())])


def fold(text: str | None, most: int = 500, overlap: int = 50, measure: Callable[[str], int] = len) -> list[tuple[str, int, int]]:
    """The chunks of a text: (content, number, size). Sentences are added while they fit; a chunk begins with the last
    sentences of the one before, one at least and more within ``overlap``. A sentence half as long again as a chunk is
    added by lines, without overlap; one of a single line stays whole. Sizes leave out the spaces between sentences."""
    chunks: list[tuple[str, int, int]] = []
    held: list[tuple[str, int]] = []

    def flush() -> None:
        chunks.append((" ".join(s for s, _ in held), len(chunks), sum(n for _, n in held)))

    sentences = [s for p in _PARAGRAPH.split(text or "") if p.strip() for x in _SENTENCE.split(p.strip()) if (s := x.strip())]
    for sentence in sentences:
        size = measure(sentence)
        lines = [x for line in sentence.split("\n") if (x := line.strip())] if size > 1.5 * most else []
        for part in lines if len(lines) > 1 else [sentence]:
            n = measure(part)
            if held and sum(m for _, m in held) + n > most:
                flush()
                kept: list[tuple[str, int]] = []
                while len(lines) < 2 and held and (not kept or sum(m for _, m in kept) + held[-1][1] <= overlap):
                    kept.insert(0, held.pop())
                held = kept
            held.append((part, n))
    if held:
        flush()
    return chunks


def words(text: str) -> int:
    return len(text.split())


def sentence_chunks(docs: DataFrame, most: int = 500, overlap: int = 50, measure: Callable[[str], int] = len, text: str = "text") -> DataFrame:
    """A row for each chunk: the documents' other columns, ``content, chunk_order_index, chars``.

    A document's fold is sequential, its sentences being read once; documents are independent, so there is no shuffle.
    Where a table comes in few files, the caller may repartition it first. ``measure`` counts characters, words, or a
    model's tokens.
    """

    @F.pandas_udf(T.ArrayType(_CHUNK))
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fold(t, most, overlap, measure))

    rows = docs.withColumn("_c", F.explode(folded(text)))
    return rows.select(*(c for c in docs.columns if c != text), "_c.*")


def whole_doc_chunks(docs: DataFrame, whole: tuple[str, ...], text: str = "text") -> DataFrame:
    """Documents of these source types as one chunk each; blank texts have none."""
    rows = docs.where(F.col("source_type").isin(*whole) & (F.trim(text) != ""))
    return rows.select(*(c for c in docs.columns if c != text), F.trim(text).alias("content"), F.lit(0).cast("long").alias("chunk_order_index"), F.length(F.trim(text)).cast("long").alias("chars"))


def chunks_by_type(docs: DataFrame, whole: tuple[str, ...], most: int = 500, overlap: int = 50) -> DataFrame:
    return whole_doc_chunks(docs, whole).unionByName(sentence_chunks(docs.where(~F.col("source_type").isin(*whole)), most, overlap))


def with_title_prefix(title: str, text: str) -> Column:
    return F.concat_ws("\n\n", F.nullif(F.trim(title), F.lit("")), F.col(text))


def md5_code(word: Column) -> Column:
    """The first 32 bits of a word's md5 as a number of either sign, for stores that other systems must be able to fill."""
    return F.conv(F.left(F.md5(word), F.lit(8)), 16, 10).cast("long") - (1 << 31)


def embed(chunks: DataFrame, dimension: int = 64, model: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, code: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Adds ``embedding`` of unit length. ``model`` makes an encoder, once in each worker; without it Spark hashes the
    words by ``code``, and they are counted with the hash's sign in ``dimension`` places. A text without words has zeros."""
    if model is not None:

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = model()
            for batch in batches:
                yield pd.Series(encode(batch.fillna("").tolist()))

        return chunks.withColumn("embedding", encoded("content"))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def counted(hashes: pd.Series) -> pd.Series:
        def one(h: np.ndarray | None) -> np.ndarray:
            h = np.zeros(0, np.int64) if h is None else np.asarray(h, np.int64)
            v = np.bincount(h % dimension, np.where(h < 0, -1.0, 1.0), dimension)
            n = np.sqrt((v * v).sum())
            return (v / n if n else v).astype(np.float32)

        return hashes.map(one)

    hashes = F.transform(F.filter(F.split(F.lower(F.coalesce("content", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: code(w))
    return chunks.withColumn("embedding", counted(hashes))


def store_documents(docs: DataFrame, path: str, prepare: Callable[[DataFrame], DataFrame] | None = None, encode: Callable[[DataFrame], DataFrame] = embed) -> DataFrame:
    """Documents (doc_id, url, title, source_type, text_content) to the store: chunked, embedded and appended by source
    type. ``doc_id, url, title, status, reason, chunks`` of every document; one that is blank or has no chunks is skipped.
    """
    prepare = prepare or (lambda rows: sentence_chunks(rows, text="text_content"))
    filled = docs.where(F.coalesce(F.trim("text_content"), F.lit("")) != "")
    chunks = written(encode(prepare(filled.select("doc_id", "text_content"))), "chunks")
    return io.store_documents(docs, chunks, path)


def new_keys(candidates: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Candidates whose key isn't stored; of those that share one the last by ``order`` stays."""
    fresh = candidates.join(stored.select(key), key, "left_anti")
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return fresh.withColumn("_k", last).where("_k = 1").drop("_k")


def fresh_documents(docs: DataFrame, stored: DataFrame | None, force: bool = False, order: str | None = None) -> DataFrame:
    """Documents (doc_id, ...) that aren't stored (doc_id), or with ``force`` all. Of rows that share a doc_id the last
    stays, in the order of the column ``order`` if it is given, else of the rows in the table."""
    placed = docs.withColumn("_place", F.monotonically_increasing_id() if order is None else F.col(order))
    last = placed.groupBy("doc_id").agg(F.max_by(F.struct(*(c for c in docs.columns if c != "doc_id")), "_place").alias("_r")).select("doc_id", "_r.*").select(*docs.columns)
    return last if force or stored is None else last.join(stored.select("doc_id"), "doc_id", "left_anti")


def index_summary(docs: DataFrame, fresh: DataFrame) -> DataFrame:
    """``source_type, total, indexed, skipped`` of documents, of which some are fresh (doc_id)."""
    marked = docs.select("doc_id", "source_type").join(fresh.select("doc_id", F.lit(1).alias("_n")), "doc_id", "left")
    return marked.groupBy("source_type").agg(F.count("*").alias("total"), F.count("_n").alias("indexed"), F.count_if(F.col("_n").isNull()).alias("skipped"))


def incremental(docs: DataFrame, stored: DataFrame, force: bool = False, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The store's next version and ``source_type, total, indexed, skipped``. Documents (doc_id, source_type, ...) that
    are stored are skipped, or with ``force`` replaced; see :func:`fresh_documents`."""
    fresh = fresh_documents(docs, stored, force, order)
    kept = stored.join(docs.select("doc_id"), "doc_id", "left_anti") if force else stored
    return kept.unionByName(fresh.select(*kept.columns)), index_summary(docs, fresh)


def add_documents(
    store: Store,
    docs: DataFrame,
    batch: str,
    force: bool = False,
    order: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    encode: Callable[[DataFrame], DataFrame] = embed,
) -> DataFrame:
    """A version of the store with these documents (doc_id, text, ...) in its table ``docs`` and their chunks with vectors
    in ``chunks``; those that were added are returned.

    Documents that are stored are skipped, or with ``force`` go with all their chunks and come anew. A batch of the same
    name replaces what it did before, so it may be repeated after a failure. Rows without doc_id aren't documents.
    """
    stored = store.read("docs", without=batch)
    change = store.change(batch)
    fresh = change.add("docs", fresh_documents(docs.where("doc_id is not null"), stored, force, order))
    if force and stored is not None:
        change.remove(fresh)
    change.add("chunks", encode((prepare or sentence_chunks)(fresh)))
    change.commit()
    return fresh


def delete_documents(ids: DataFrame, docs: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and embeddings without those documents (doc_id)."""
    gone = chunks.join(ids, "doc_id", "left_semi").select("chunk_id")
    return docs.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti"), embeddings.join(gone, "chunk_id", "left_anti")


def detach(graph: DataFrame, chunk_ids: Column, file_paths: Column, mark: str = "<SEP>") -> DataFrame:
    """Graph elements (source_id, file_path: lists in one text) without these ids and paths; one whose lists are both
    empty goes."""
    left = lambda c, gone: F.array_except(F.split(c, mark), gone)
    rows = graph.withColumns({"_s": left("source_id", chunk_ids), "_f": left("file_path", file_paths)}).where((F.size("_s") > 0) | (F.size("_f") > 0))
    return rows.withColumns({"source_id": F.array_join("_s", mark), "file_path": F.array_join("_f", mark)}).drop("_s", "_f")


def crawl_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("source_type").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("stored"))


def news_to_document(items: DataFrame, articles: DataFrame) -> DataFrame:
    """``url, title, text``: the header lines that are known, a blank line, and the article's text, or else the title."""
    joined = items.join(articles.select("url", F.col("text").alias("_body")), "url", "left")
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    head = F.concat_ws("\n", line("Title", F.col("title")), line("Category", F.col("category")), line("Date", F.col("date")), line("URL", F.col("url")))
    return joined.select("url", "title", F.concat(head, F.lit("\n\n"), F.coalesce(F.nullif("_body", F.lit("")), F.col("title"))).alias("text"))


def first_seen(items: DataFrame) -> DataFrame:
    """Items (page, pos, url) at their first place, up to the first page that adds none."""
    first = items.withColumn("_k", F.row_number().over(Window.partitionBy("url").orderBy("page", "pos")))
    adds = first.groupBy("page").agg(F.count_if(F.col("_k") == 1).alias("n"))
    stop = adds.where("n = 0").agg(F.min("page").alias("stop"))
    return first.where("_k = 1").drop("_k").crossJoin(F.broadcast(stop)).where("stop is null or page < stop").drop("stop")


def latest_items(items: DataFrame, limit: int) -> DataFrame:
    """The first 1 to 20 items (page, pos, title, date, url) and a line for each of what is known."""
    dated = F.when(F.coalesce("date", F.lit("")) != "", F.concat(F.lit(" ("), "date", F.lit(")"))).otherwise("")
    at = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit(": "), "url")).otherwise("")
    return items.orderBy("page", "pos").limit(min(max(limit, 1), 20)).withColumn("line", F.concat(F.lit("- "), "title", dated, at))


def descendants(edges: DataFrame, roots: DataFrame, written: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``page_id``: the roots (page_id, with_children) and, where asked for, all pages below (edges: parent, child).

    Each page looks up its ancestors in steps that double, so the rounds are the logarithm of the depth. A page that meets
    a root is done, one that comes to a top is dropped, and cycles end when a step is as long as there are pages. Where a
    page has several parents, the pages are walked level by level. ``written`` cuts the plan of each round.
    """
    opened = written(roots.where("with_children").select("page_id").distinct())
    parents = written(edges.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("above"), (F.max("parent") > F.min("parent")).alias("several")))
    if not parents.where("several").isEmpty():
        return _below(edges, roots, opened, written)
    met = bounded(opened.select(F.col("page_id").alias("above"), F.lit(True).alias("_met")))
    rows = written(parents.join(met, "above", "left").select(F.col("child").alias("page_id"), "above", F.coalesce("_met", F.lit(False)).alias("met")))
    most, step, done = rows.count(), 1, []
    while True:
        done.append(rows.where("met").select("page_id", "above", "met"))
        live = rows.where("not met")
        if step >= most or live.isEmpty():
            break
        # A page that isn't there has no ancestor left.
        known = functools.reduce(DataFrame.union, done, live).select(F.col("page_id").alias("_page"), F.col("above").alias("_above"), F.col("met").alias("_met"))
        rows = written(live.join(known, F.col("above") == F.col("_page")).select("page_id", F.col("_above").alias("above"), F.col("_met").alias("met")))
        step *= 2
    found = functools.reduce(DataFrame.union, done).select("page_id")
    return roots.select("page_id").union(found).distinct()


def _below(edges: DataFrame, roots: DataFrame, level: DataFrame, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Level by level; pages that were seen aren't followed again."""
    seen = written(roots.select("page_id").distinct())
    while not level.isEmpty():
        below = level.join(edges, level["page_id"] == edges["parent"]).select(F.col("child").alias("page_id")).distinct()
        level = written(below.join(seen, "page_id", "left_anti"))
        seen = written(seen.union(level))
    return seen


def leaf_pages(pages: DataFrame) -> DataFrame:
    return pages.join(pages.where("parent_id is not null").select(F.col("parent_id").alias("page_id")).distinct(), "page_id", "left_anti")


def pdf_attachments(attachments: DataFrame, base: str) -> DataFrame:
    """Attachments (title, media_type, download) of PDF, with their absolute address ``url``."""
    pdf = F.coalesce(F.col("media_type").ilike("%pdf%"), F.lit(False)) | F.col("title").ilike("%.pdf")
    return attachments.where(pdf).withColumn("url", F.when(F.col("download").startswith("http"), F.col("download")).otherwise(F.concat(F.lit(base.rstrip("/")), "download")))


def crawl_frontier(links: DataFrame, seeds: DataFrame, max_pages: int, written: Callable[[DataFrame], DataFrame] = written, exclude: str = r"$^", per_page: int = 100) -> DataFrame:
    """``url, level, place``: pages reached from the seeds (url) over links (url, pos, link) on the same host.

    Breadth first, in the order of the places: queries and fragments are dropped, addresses that match ``exclude`` and
    pages already found aren't followed, a page adds up to ``per_page`` links that no page before it has added, and the
    first ``max_pages`` stay. Places are counted through all levels; seeds are in the order of their addresses.
    """
    spark, folder = links.sparkSession, fresh_path(links.sparkSession, "frontier")
    bare = lambda c: F.regexp_replace(c, r"[?#].*$", "")
    host = lambda c: F.regexp_extract(c, r"^[a-z]+://([^/]+)", 1)
    ways = links.select(bare(F.col("url")).alias("page"), "pos", bare(F.col("link")).alias("next"))
    ways = ways.where((host(F.col("page")) == host(F.col("next"))) & ~F.col("next").rlike(exclude))
    ways = written(ways.groupBy("page", "next").agg(F.min("pos").alias("pos")))
    first = seeds.where("url is not null").select(bare(F.col("url")).alias("next")).distinct()
    level, size, number = numbered(first, "next").select(F.col("next").alias("url"), F.col("i").alias("place")), 0, 0
    while True:
        # Each level is a folder of its own; those before it aren't written again.
        path = f"{folder}/level={number}"
        level.where(F.col("place") < max_pages).write.mode("overwrite").parquet(path)
        level = spark.read.schema("url string, place long").parquet(path)
        seen = spark.read.schema("url string, place long, level int").parquet(folder)
        added = level.count()
        size, number = size + added, number + 1
        if not added or size >= max_pages:
            return seen.select("url", "level", "place")
        offered = ways.join(level.withColumnRenamed("url", "page"), "page").join(seen.select(F.col("url").alias("next")), "next", "left_anti")
        taken = _taken(written(offered.select("page", "place", "pos", "next")), per_page, written)
        level = numbered(taken, "at", "next").select(F.col("next").alias("url"), (F.col("i") + size).alias("place"))


def _taken(offered: DataFrame, per_page: int, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``next, at``: the links (page, place, pos, next) that pages add one after the other, each its first ``per_page``
    that none before it has added.

    All pages ask at once for their first links; a link goes to the first page that asks, and pages that were turned away
    ask for further ones, until none is. A page that has no more links than it may add has nothing to ask for again.
    """
    at = F.min(F.struct("place", "pos")).alias("at")
    while True:
        ranked = offered.withColumn("_k", F.row_number().over(Window.partitionBy("page").orderBy("pos", "next")))
        asked = ranked.where(F.col("_k") <= per_page)
        taken = asked.groupBy("next").agg(at)
        full = offered.groupBy("page").agg(F.count("*").alias("_n")).where(F.col("_n") > per_page).select("page")
        lost = asked.join(full, "page", "left_semi").join(taken, "next").where("place > at.place").select("page", "next")
        lost = written(lost)
        if lost.isEmpty():
            return taken
        offered = written(offered.join(lost, ["page", "next"], "left_anti"))
