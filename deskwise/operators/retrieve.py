"""Retrieval for many queries at once: exact vector search, fusion of ranked lists, re-ranking, context."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from deskwise.sources.shared import bounded, written

#: Queries that are compared at once, and rows of the corpus in one matrix product.
BLOCK, PIECE = 1024, 2048


def cosine(a: str, b: str) -> Column:
    """Cosine of two float arrays in doubles; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(F.col(a), F.col(b)), F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b))))


def _ranked(rows: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """Adds ``pos`` from 0 and keeps the first k. The row number itself is bounded, so tasks drop later rows before they are shuffled."""
    window = Window.partitionBy(by).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k)
    return first.withColumn("pos", F.col("_n").cast("long") - 1).drop("_n")


def _unit(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows of length one; of NaN where they have none."""
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.full_like(rows, np.nan), where=length > 0)


class _Best:
    """The k best rows of each of ``n`` queries among all that are added, ties by id; what is held is bounded."""

    def __init__(self, n: int, k: int, threshold: float | None) -> None:
        self.k, self.threshold, self.most = k, threshold, 4 * n * k + PIECE
        self.floor = np.full(n, -np.inf)  # a further row must reach it
        self.held: list[pd.DataFrame] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        out = np.isnan(scores) if self.threshold is None else ~(scores > self.threshold)
        scores[out] = -np.inf
        floor, m = self.floor, scores.shape[1]
        if m > self.k:
            floor = np.maximum(floor, np.partition(scores, m - self.k, axis=1)[:, m - self.k])
        of, at = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        self.held.append(pd.DataFrame({"of": of, "score": scores[of, at], "id": ids[at]}))
        self.size += len(of)
        if self.size > self.most:
            self.rows()

    def rows(self) -> pd.DataFrame:
        found = pd.concat(self.held).sort_values(["of", "score", "id"], ascending=[True, False, True])
        place = found.groupby("of").cumcount()
        last = found[place == self.k - 1]
        self.floor[last["of"]] = last["score"]
        self.held = [found[place < self.k]]
        self.size = len(self.held[0])
        return self.held[0]


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, workspace: str | None = None, threshold: float | None = None, most: int | None = None) -> DataFrame:
    """``query_id, id, score, pos``: the k nearest rows of the corpus (id, embedding) by cosine, ties by id.

    A block of queries (query_id, embedding) goes to all tasks, and the corpus is scanned where it lies: no vector of it is
    shuffled, and a task sends the k best rows of each query over all it read. Up to ``BLOCK`` queries are one block and
    one scan; of more, blocks are read one by one from a written table, each for a scan of its own, so the driver holds
    one block at a time. Rows without length are no match. ``most`` limits k, ``threshold`` is exclusive.
    """
    k = k if most is None else min(k, most)
    if workspace is not None:
        corpus = corpus.where(F.col("workspace") == workspace)
    rows = corpus.where("embedding is not null").select(F.col("id").cast("string").alias("id"), "embedding")

    def scan(block: pa.Table) -> DataFrame:
        block = block.combine_chunks()
        names = block["query_id"].to_numpy()
        asked = _unit(block["embedding"].chunk(0)) if block.num_rows else None

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if asked is None:
                return
            held = _Best(len(asked), k, threshold)
            for batch in batches:
                for at in range(0, batch.num_rows, PIECE):
                    part = batch.slice(at, PIECE)
                    held.add(np.round(asked @ _unit(part["embedding"]).T, 9), part["id"].to_numpy(zero_copy_only=False))
            if held.held:
                out = held.rows()
                yield pa.RecordBatch.from_arrays([pa.array(names[out["of"]], pa.int64()), pa.array(out["id"], pa.string()), pa.array(out["score"], pa.float64())], names=["query_id", "id", "score"])

        return _ranked(rows.mapInArrow(best, "query_id long, id string, score double"), k, F.col("score").desc(), F.col("id"))

    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    first = asked.limit(BLOCK + 1).toArrow()
    if first.num_rows <= BLOCK:
        return scan(first)
    n = -(-asked.count() // BLOCK)
    blocks = written(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")), "query-blocks")
    found = [written(scan(blocks.where(F.col("block") == i).select("query_id", "embedding").toArrow()), "nearest") for i in range(n)]
    return reduce(DataFrame.unionByName, found)


def hyperplane_buckets(rows: DataFrame, key: str, tables: int, bits: int, probes: int = 0, seed: int = 7) -> DataFrame:
    """``key, bucket``: a bucket in each of ``tables`` tables for every row with a vector (embedding), by the sides of
    ``bits`` random planes; with ``probes`` also the buckets across the planes that are nearest to the vector."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _unit(batch["embedding"])
            planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], tables * bits))
            there = np.flatnonzero(~np.isnan(vectors[:, :1]).any(axis=1))
            side = (vectors[there] @ planes).reshape(len(there), tables, bits)
            power = 1 << np.arange(bits)
            codes = ((side > 0) * power).sum(axis=2)
            near = np.argsort(np.abs(side), axis=2)[:, :, :probes]
            every = np.concatenate([codes[:, :, None], codes[:, :, None] ^ power[near]], axis=2) + (np.arange(tables) << bits)[None, :, None]
            of = np.repeat(there, tables * (probes + 1))
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(of)), pa.array(every.reshape(-1), pa.int64())], names=[key, "bucket"])

    return rows.where("embedding is not null").select(key, "embedding").mapInArrow(coded, f"{key} {rows.schema[key].dataType.simpleString()}, bucket long")


def approximate_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, tables: int = 32, bits: int = 8, probes: int = 3) -> DataFrame:
    """As :func:`vector_topk`, of the rows alone that share a bucket of random planes with the query; off by default.

    Only ids are bucketed and shuffled; the vectors of distinct candidates are fetched, and their cosines are exact. More
    tables and probes find more, more bits compare less. No bucket is capped. Vectors without neighbours, such as random
    ones, are hard for any index: of those in the test data the default finds 0.93 and compares 0.41 of all pairs (sf0.1).
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    rows = corpus.select(F.col("id").cast("string").alias("id"), "embedding")
    of = hyperplane_buckets(asked, "query_id", tables, bits, probes)
    pairs = hyperplane_buckets(rows, "id", tables, bits).join(bounded(of), "bucket").select("query_id", "id").distinct()
    both = pairs.join(rows, "id").join(bounded(asked.withColumnRenamed("embedding", "asked"), BLOCK), "query_id")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = (_unit(batch["asked"]) * _unit(batch["embedding"])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["id"], pa.array(np.round(score, 9))], names=["query_id", "id", "score"])

    found = both.select("query_id", "id", "asked", "embedding").mapInArrow(scored, "query_id long, id string, score double")
    return _ranked(found, k, F.col("score").desc(), F.col("id"))


def hybrid_search(queries: DataFrame, corpus: DataFrame, k: int = 10, workspace: str | None = None) -> DataFrame:
    """The vector search under its other name."""
    return vector_topk(queries, corpus, k, workspace)


def graph_candidates(query_entities: DataFrame, entity_chunks: DataFrame, k: int = 60) -> DataFrame:
    """``query_id, id, freq, pos``: chunks of a query's entities; freq counts the entities that lead to a chunk, and
    the order is that of the first such entity, then of the id.

    A chunk among a query's first k is among the first k of the entity it comes by, as those before it there come no later
    for the query. So a query meets k chunks of each of its entities, and freq is counted for what is given out alone:
    nothing grows with queries times chunks. Links without an entity or a chunk lead nowhere.
    """
    links = entity_chunks.where("entity is not null and chunk_id is not null").select("entity", F.col("chunk_id").alias("id"))
    asked = query_entities.select("query_id", "entity", "pos")
    near = _ranked(links.distinct(), k, F.col("id"), by="entity").select("entity", "id")
    hits = asked.join(near, "entity").groupBy("query_id", "id").agg(F.min("pos").alias("first"))
    chosen = _ranked(hits, k, F.col("first").asc_nulls_last(), F.col("id")).drop("first")
    known = links.join(near.select("id").distinct(), "id", "left_semi").groupBy("entity", "id").agg(F.count("*").alias("n"))
    ways = chosen.join(asked.drop("pos"), "query_id").join(known, ["entity", "id"])
    return ways.groupBy("query_id", "id").agg(F.sum("n").alias("freq"), F.first("pos").alias("pos"))


def rank_fusion(vector: DataFrame, entity: DataFrame, relation: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, id, score, pos``: the fusion of three ranked lists (query_id, id, pos from 0, and freq).

    A hit counts its list's weight over 3 pos + 1, 2 or 3; graph hits grow with freq up to threefold. A chunk of the
    vector list adds 1.15 of its graph hits; for others the first graph hit counts 0.9. Ties: vector list first, then
    entities, relations, each by position.
    """
    bonus = F.least(F.lit(3.0), 1 + 0.35 * F.log1p(F.greatest(F.col("freq") - 1, F.lit(0)).cast("double")))
    value = lambda weight, offset: weight / (3 * F.col("pos") + offset).cast("double")
    hits = (
        vector.select("query_id", "id", "pos", F.lit(0).alias("list"), value(F.lit(1.2), 1).alias("value"))
        .unionByName(entity.select("query_id", "id", "pos", F.lit(1).alias("list"), (value(F.lit(0.8), 2) * bonus).alias("value")))
        .unionByName(relation.select("query_id", "id", "pos", F.lit(2).alias("list"), (value(F.lit(0.6), 3) * bonus).alias("value")))
    )
    graph = F.when(F.col("list") > 0, F.col("value"))
    place = F.struct("list", "pos")
    sums = hits.groupBy("query_id", "id").agg(
        F.max(F.when(F.col("list") == 0, F.col("value"))).alias("v"), F.coalesce(F.sum(graph), F.lit(0.0)).alias("g"), F.min_by(graph, place).alias("first"), F.min(place).alias("place")
    )
    score = F.when(F.col("v").isNotNull(), F.col("v") + 1.15 * F.col("g")).otherwise(F.col("g") - 0.1 * F.col("first"))
    rows = sums.select("query_id", "id", F.round(score, 9).alias("score"), "place")
    return _ranked(rows, k, F.col("score").desc(), F.col("place.list"), F.col("place.pos"), F.col("id")).drop("place")


def overlap_score(question: str, content: str) -> Column:
    """The share of the question's distinct words that stand in the content; null for a question without words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.try_divide(F.size(F.array_intersect(words(question), words(content))).cast("double"), F.size(words(question)).cast("double"))


def model_score(model: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[str, str], Column]:
    """A scorer for :func:`rerank` that runs a model, made once in each worker, on batches of questions and contents.

    Where the model can't be made or fails on a batch, its rows have no score and so keep the order they were given in.
    """

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            score = model()
        except Exception as error:
            logging.getLogger(__name__).warning("no model, rows keep their order: %s", error)
            score = None
        for questions, contents in batches:
            found = None
            if score is not None:
                try:
                    found = pd.Series(score(questions.fillna("").tolist(), contents.fillna("").tolist()), dtype="float64")
                except Exception as error:
                    logging.getLogger(__name__).warning("a batch without scores: %s", error)
            yield pd.Series([None] * len(questions), dtype="float64") if found is None or len(found) != len(questions) else found

    return lambda question, content: F.nanvl(scored(F.col(question), F.col(content)), F.lit(None).cast("double"))


def rerank(candidates: DataFrame, k: int, scorer: Callable[[str, str], Column] = overlap_score) -> DataFrame:
    """Candidates (query_id, id, pos, question, content) by ``rerank_score``, the best k; equal scores keep their order
    and rows without a score follow in theirs. ``scorer`` gives a column, which may be a pandas UDF."""
    rows = candidates.withColumn("rerank_score", scorer("question", "content")).withColumnRenamed("pos", "was")
    return _ranked(rows, k, F.col("rerank_score").desc_nulls_last(), F.col("was"), F.col("id"))


def distinct_sources(retrieved: DataFrame, references: DataFrame, k: int, http_only: bool = False) -> DataFrame:
    """``query_id, file_path, pos``: the paths of chunks, then of references (both query_id, file_path, pos), each
    once, the first k. ``http_only`` keeps addresses among the first 3k."""
    both = retrieved.select("query_id", "file_path", F.lit(0).alias("list"), "pos").unionByName(references.select("query_id", "file_path", F.lit(1).alias("list"), "pos"))
    first = both.where("file_path <> ''").groupBy("query_id", "file_path").agg(F.min(F.struct("list", "pos")).alias("first"))
    order = (F.col("first.list"), F.col("first.pos"), F.col("file_path"))
    if http_only:
        first = _ranked(first, 3 * k, *order).where(F.col("file_path").startswith("http")).drop("pos")
    return _ranked(first, k, *order).drop("first")


def assemble_context(retrieved: DataFrame, max_chunks: int = 3, max_chars: int = 2500, header: str = "Context:", source: str = "Source") -> DataFrame:
    """``query_id, context`` from retrieved (query_id, pos, content, file_path).

    Of the first ``max_chunks`` rows those without content are left out. Each text is followed by the number of its address,
    in the order of first appearance, or by another path's name, or by nothing where there is no path. A longer context is
    cut at its last line end within ``max_chars``.
    """
    used = retrieved.where((F.col("pos") < max_chunks) & (F.coalesce("content", F.lit("")) != ""))
    web = F.when(F.col("file_path").startswith("http"), F.col("file_path"))
    first = used.withColumn("web", web).withColumn("_first", F.when(web.isNotNull(), F.min("pos").over(Window.partitionBy("query_id", "web"))))
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("_first").asc_nulls_last()))
    mark = F.when(F.col("web").isNotNull(), F.concat(F.lit(f"\n[{source} "), number.cast("string"), F.lit("]"))).when(F.col("file_path") != "", F.concat(F.lit(f"\n{source}: "), "file_path")).otherwise("")
    block = first.withColumn("_block", F.concat(F.btrim("content", F.lit(" \t\n\r\f\v")), mark))
    joined = block.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_block"))).alias("b"))
    text = F.concat(F.lit(f"{header}\n"), F.array_join(F.transform("b", lambda x: x["_block"]), "\n---\n"))
    cut = F.regexp_replace(F.left(text, F.lit(max_chars)), r"\n[^\n]*\z", "")  # $ would match before a last line end too, and cut two lines
    return joined.select("query_id", F.when(F.length(text) > max_chars, cut).otherwise(text).alias("context"))


def format_context(retrieved: DataFrame, queries: DataFrame, source: str = "Source", empty: str = "Nothing was found.") -> DataFrame:
    """``query_id, context``: numbered texts, each with its address, whatever it is, on the next line if it has one."""
    line = F.concat_ws("\n", F.concat(F.lit(f"{source} "), (F.col("pos") + 1).cast("string"), F.lit(": "), F.coalesce("content", F.lit(""))), F.when(F.col("file_path") != "", F.concat(F.lit("URL: "), "file_path")))
    texts = retrieved.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n\n---\n\n").alias("context"))
    return queries.select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce("context", F.lit(empty)).alias("context"))


def source_links(answers: DataFrame, sources: DataFrame, label: str = "More") -> DataFrame:
    """``query_id, url, label``: the addresses that an answer's numbers name (answers: query_id, numbers; sources:
    query_id, number, url), each once and numbered anew."""
    named = answers.select("query_id", F.posexplode("numbers").alias("at", "number")).join(sources, ["query_id", "number"])
    first = named.where(F.col("url").startswith("http")).groupBy("query_id", "url").agg(F.min("at").alias("at"))
    rows = _ranked(first, 1 << 30, F.col("at"))
    return rows.select("query_id", "url", F.concat(F.lit(f"{label} "), (F.col("pos") + 1).cast("string")).alias("label"))


def prompt(question: str, context: str, dialog: str, longest: int = 500) -> Column:
    """The sections that aren't blank: dialog, context, and the question cut to ``longest`` characters."""

    def section(title: str, text: Column) -> Column:
        return F.when(F.coalesce(F.trim(text), F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), F.trim(text)))

    return F.concat_ws("\n\n", section("Dialog", F.col(dialog)), section("Context", F.col(context)), section("Question", F.left(F.trim(question), F.lit(longest))))


def chosen_query(context_expanded: str, expanded: str, original: str, longest: int = 1500) -> Column:
    """The first of the three that isn't blank, cut to ``longest`` characters."""
    return F.left(F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (context_expanded, expanded)), F.col(original)), F.lit(longest))


def expand_abbreviations(questions: DataFrame, glossary: DataFrame) -> DataFrame:
    """Adds ``expanded``: after each word that the glossary (short, long) has, its long form in brackets.

    Words are what stands between spaces, compared in lower case; the glossary is joined, not searched by each row.
    """
    words = questions.select("query_id", F.posexplode(F.split("question", " ")).alias("at", "w")).withColumn("short", F.lower(F.regexp_replace("w", r"[^\p{L}\p{N}]", "")))
    known = words.join(glossary.select(F.lower("short").alias("short"), "long").dropDuplicates(["short"]), "short", "left")
    told = known.withColumn("w", F.when(F.col("long").isNull(), F.col("w")).otherwise(F.concat("w", F.lit(" ("), "long", F.lit(")"))))
    lines = told.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]), " ").alias("expanded"))
    return questions.join(lines, "query_id", "left")
