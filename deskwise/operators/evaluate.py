"""Retrieval quality: metrics of each query, means, intervals, comparison, and mining of benchmark items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskwise.sources.shared import written

KS, NDCG_KS = (1, 3, 5, 10), (5, 10)
METRICS = ("hit_rate@1", "hit_rate@5", "hit_rate@10", "mrr", *(f"recall@{k}" for k in KS), *(f"precision@{k}" for k in KS), *(f"ndcg@{k}" for k in NDCG_KS))


def unique_ranks(retrieved: DataFrame) -> DataFrame:
    """``query_id, key, rank`` from 1: each key of a query once, in the order of first appearance."""
    first = retrieved.groupBy("query_id", "key").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "key")).cast("long")).drop("pos")


def ground_truth(items: DataFrame, primary: str = "confluence_url", others: str = "relevant_urls") -> DataFrame:
    """``query_id, key``: an item's canonical addresses; blanks and ``None`` are dropped, items without any have no row."""
    from deskwise.functions.urls import canonical_page

    every = items.select(F.col("id").alias("query_id"), F.explode(F.concat(F.array(primary), F.coalesce(others, F.array().cast("array<string>")))).alias("url"))
    kept = every.where((F.coalesce(F.trim("url"), F.lit("")) != "") & (F.trim("url") != "None"))
    return kept.select("query_id", canonical_page("url").alias("key")).distinct()


def per_query_metrics(retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """A row for each query with truth (query_id, key): hit rate, reciprocal rank, recall, precision and NDCG of what
    was retrieved (query_id, key, pos). Precision divides by k even where fewer were retrieved."""
    truth = truth.distinct()
    relevant = truth.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    return hit_metrics(unique_ranks(retrieved).join(truth, ["query_id", "key"]), relevant)


def group_hits(retrieved: DataFrame, queries: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of retrieved (query_id, key, ...) whose key is true for the query, where what is true are the members (group,
    key, own) of the query's group (queries: query_id, group) but those that are the query's ``own``.

    Truth that groups tell isn't made of pairs: only what was retrieved is looked up.
    """
    asked = retrieved.select("query_id", "key").distinct().join(queries.select("query_id", "group").distinct(), "query_id")
    there = members.join(retrieved.select("key").distinct(), "key", "left_semi").distinct()
    true = asked.join(there, ["group", "key"]).where("own <> query_id").select("query_id", "key").distinct()
    return retrieved.join(true, ["query_id", "key"], "left_semi")


def group_sizes(queries: DataFrame, members: DataFrame) -> DataFrame:
    """``query_id, n_rel``: how many keys :func:`group_hits` holds true for a query, where there are any.

    Counted by group, less the query's own; of a query with several groups, a key that they share counts for each.
    """
    keys = members.where("own is not null").groupBy("group", "key").agg(F.min("own").alias("query_id"), F.max("own").alias("_last"))
    sizes = keys.groupBy("group").agg(F.count("*").alias("n"))
    alone = keys.where("query_id = _last").groupBy("group", "query_id").agg(F.count("*").alias("less"))
    counted = queries.select("query_id", "group").distinct().join(sizes, "group").join(alone, ["group", "query_id"], "left")
    return counted.groupBy("query_id").agg(F.sum(F.col("n") - F.coalesce("less", F.lit(0))).alias("n_rel")).where("n_rel > 0")


def hit_metrics(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """The metrics of :func:`per_query_metrics` from the true ones of the ranked keys (query_id, rank) and the number of
    all true ones (query_id, n_rel)."""
    relevant = relevant.select("query_id", F.col("n_rel").cast("double").alias("n_rel"))
    rank, one = F.col("rank"), lambda k: F.count_if(F.col("rank") <= k).cast("double")
    gain = 1 / F.log2(rank.cast("double") + 1)
    sums = hits.groupBy("query_id").agg(F.min("rank").alias("best"), *(one(k).alias(f"h{k}") for k in KS), *(F.sum(F.when(rank <= k, gain)).alias(f"g{k}") for k in NDCG_KS))
    joined = relevant.join(sums, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def ideal(k: int) -> Column:
        best = F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int")))
        return F.aggregate(best, F.lit(0.0), lambda s, i: s + 1 / F.log2(i.cast("double") + 1))

    return joined.select(
        "query_id",
        *(F.when(zero(f"h{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_rate@{k}") for k in KS),
        zero(1 / F.col("best").cast("double")).alias("mrr"),
        *(zero(F.col(f"h{k}") / F.col("n_rel")).alias(f"recall@{k}") for k in KS),
        *(zero(F.col(f"h{k}") / F.lit(float(k))).alias(f"precision@{k}") for k in KS),
        *(zero(F.col(f"g{k}") / ideal(k)).alias(f"ndcg@{k}") for k in NDCG_KS),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """``metric, value`` of the reported metrics; 0 without queries."""
    means = per_query.agg(*(F.coalesce(F.avg(f"`{m}`"), F.lit(0.0)).alias(m) for m in METRICS))
    return means.unpivot([], list(METRICS), "metric", "value")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``i``, the row's number from 0 in an order. Tasks sort ranges; the counts of the ranges come together."""
    placed = written(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("n"))
    before = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))
    return placed.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("i", F.col("_before") + at).drop("_m", "_p", "_before")


def _gathered(per_query: DataFrame, n_boot: int, seed: int, held: int) -> DataFrame | None:
    """The means of each sample, gathered from the metrics as one matrix, if that has at most ``held`` rows."""
    names = [f"`{m}`" for m in METRICS]
    table = per_query.select("query_id", *names).limit(held + 1).toArrow()
    if table.num_rows > held:
        return None
    table = table.sort_by("query_id")
    matrix = np.stack([table[m].to_numpy() for m in METRICS], axis=1)
    n = len(matrix)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch["id"].to_pylist() if n else []:
                drawn = [int(hashlib.md5(f"{b}|{d}|{seed}".encode()).hexdigest()[:8], 16) % n for d in range(n)]
                out.append(matrix[drawn].mean(axis=0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.stack(out, axis=1)], names=list(METRICS))

    return per_query.sparkSession.range(n_boot).mapInArrow(means, ", ".join(f"{m} double" for m in names))


def _shuffled(per_query: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """The same where there are more queries than a task should hold: draws meet the metrics of their row once."""
    rows = numbered(per_query, "query_id")
    n = per_query.agg(F.count("*").alias("n"))
    draws = per_query.sparkSession.range(n_boot).withColumnRenamed("id", "b").crossJoin(F.broadcast(n)).select("b", "n", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).alias("d"))
    digest = F.substring(F.md5(F.concat_ws("|", F.col("b").cast("string"), F.col("d").cast("string"), F.lit(str(seed)))), 1, 8)
    picks = draws.select("b", (F.conv(digest, 16, 10).cast("long") % F.col("n")).alias("i")).groupBy("b", "i").agg(F.count("*").alias("times"))
    means = picks.join(rows, "i").groupBy("b").agg(*((F.sum(F.col(f"`{m}`") * F.col("times")) / F.sum("times")).alias(m) for m in METRICS))
    return means.drop("b")


def bootstrap_ci(per_query: DataFrame, n_boot: int = 1000, ci: float = 0.95, seed: int = 42, held: int = 100_000) -> DataFrame:
    """``metric, mean, low, high``: linear percentiles of the means of ``n_boot`` samples with replacement.

    Draw i of sample b is the row whose number is the first eight hex digits of md5(b|i|seed) modulo the rows, numbered
    in the order of query_id. Up to ``held`` rows of metrics go to each task, which draws its samples from them; nothing of
    the size of all draws is shuffled. Of more rows, draws are joined with them.
    """
    means = _gathered(per_query, n_boot, seed, held)
    weighted = (_shuffled(per_query, n_boot, seed) if means is None else means).unpivot([], list(METRICS), "metric", "mean")
    tail = (1 - ci) / 2
    ends = weighted.groupBy("metric").agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))
    return mean_metrics(per_query).withColumnRenamed("value", "mean").join(ends, "metric", "left")


def comparison(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``metric, value, baseline, delta`` of the reported metrics, rounded to 4 places; 0 where one is missing."""
    names = current.sparkSession.createDataFrame([(m,) for m in METRICS], "metric string")
    joined = names.join(current.select("metric", "value"), "metric", "left").join(baseline.select("metric", F.col("value").alias("b")), "metric", "left")
    value, base = F.coalesce("value", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return joined.select("metric", F.round(value, 4).alias("value"), F.round(base, 4).alias("baseline"), F.round(value - base, 4).alias("delta"))


def entity_doc_frequency(entity_chunks: DataFrame, chunks: DataFrame, noise: DataFrame, low: int = 2, high: int = 30) -> DataFrame:
    """``entity, docs``: entities, noise aside, of ``low`` to ``high`` documents; chunks that aren't known don't count."""
    joined = entity_chunks.join(chunks.select(F.col("id").alias("chunk_id"), "full_doc_id"), "chunk_id").join(noise, "entity", "left_anti")
    return joined.groupBy("entity").agg(F.countDistinct("full_doc_id").alias("docs")).where(F.col("docs").between(low, high))


def doc_entities(entity_chunks: DataFrame, chunks: DataFrame, noise: DataFrame) -> DataFrame:
    """``full_doc_id, entities``: documents with two or more entities besides noise, sorted."""
    joined = entity_chunks.join(chunks.select(F.col("id").alias("chunk_id"), "full_doc_id"), "chunk_id").join(noise, "entity", "left_anti")
    return joined.groupBy("full_doc_id").agg(F.array_sort(F.collect_set("entity")).alias("entities")).where(F.size("entities") >= 2)


def _order(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def cross_document_pairs(entity_chunks: DataFrame, chunks: DataFrame, frequent: DataFrame, per_entity: int = 2, seed: int = 42) -> DataFrame:
    """``entity, doc_a, doc_b``: up to ``per_entity`` pairs of documents of each entity of bounded frequency.

    ``frequent`` (entity) bounds how many documents an entity has, and so the pairs of each.
    """
    of = entity_chunks.join(frequent.select("entity"), "entity").join(chunks.select(F.col("id").alias("chunk_id"), F.col("full_doc_id").alias("doc")), "chunk_id").select("entity", "doc").distinct()
    pairs = of.withColumnRenamed("doc", "doc_a").join(of.withColumnRenamed("doc", "doc_b"), "entity").where("doc_a < doc_b")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(_order(seed, "entity", "doc_a", "doc_b")))
    return pairs.withColumn("_k", rank).where(F.col("_k") <= per_entity).drop("_k")


def mine_items(candidates: DataFrame, target: int, per_chunk: int = 3, seed: int = 42) -> DataFrame:
    """Candidate items (category, chunk_id, content): at most ``per_chunk`` of a chunk and ``target`` of a category, in
    an order drawn by md5; with their item ids, texts cut to 500 characters, and the prompt a question is asked by."""
    used = F.row_number().over(Window.partitionBy("chunk_id").orderBy(_order(seed, "category", "chunk_id")))
    kept = candidates.withColumn("_u", used).where(F.col("_u") <= per_chunk)
    place = F.row_number().over(Window.partitionBy("category").orderBy(_order(seed + 1, "category", "chunk_id"), "chunk_id"))
    kept = kept.withColumn("_p", place).where(F.col("_p") <= target)
    text = F.left("content", F.lit(500))
    return kept.select(item_id("category", F.concat_ws("|", "category", "chunk_id")).alias("id"), "category", "chunk_id", text.alias("chunk_text"), F.concat(F.lit("Ask one question of kind "), "category", F.lit(" that this text answers:\n"), text).alias("prompt"))


def item_id(prefix: str | Column, key: Column) -> Column:
    return F.concat(prefix, F.lit("-"), F.left(F.md5(key), F.lit(12)))
