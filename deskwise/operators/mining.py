"""Benchmark items of all four categories, under caps that the categories share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskwise.operators.evaluate import _order, cross_document_pairs, doc_entities, entity_doc_frequency, item_id
from deskwise.sources.shared import bounded, written

CATEGORIES = ("cross_document", "discipline", "conditional", "direct")


def accepted(candidates: DataFrame, capacity: DataFrame) -> DataFrame:
    """The candidates (place, resources) that get all they ask for, when one after the other, by ``place``, takes a unit of
    each of its resources where all still have one. ``capacity`` (resource, units); places differ.

    In each round a candidate is taken if, of all its resources, what is left is enough for it and for every undecided
    candidate before it, and dropped once a resource of its own is used up. So the first undecided one is decided in
    every round, and the outcome is that of the sequence.
    """
    undecided = written(candidates.select("place", F.array_distinct("resources").alias("resources")), "undecided")
    taken = written(undecided.limit(0), "taken")
    while not undecided.isEmpty():
        used = taken.select(F.explode("resources").alias("resource")).groupBy("resource").agg(F.count("*").alias("used"))
        left = capacity.join(used, "resource", "left").select("resource", (F.col("units") - F.coalesce("used", F.lit(0))).alias("left"))
        asked = undecided.select("place", F.explode_outer("resources").alias("resource")).join(left, "resource", "left")
        rank = F.row_number().over(Window.partitionBy("resource").orderBy("place"))
        spare = F.when(F.col("resource").isNotNull(), F.coalesce("left", F.lit(0)))
        judged = asked.select("place", (rank <= spare).alias("fits"), (spare <= 0).alias("full"))
        verdicts = judged.groupBy("place").agg(F.bool_and(F.coalesce("fits", F.lit(True))).alias("fits"), F.bool_or(F.coalesce("full", F.lit(False))).alias("full"))
        judged = written(undecided.join(verdicts, "place"), "judged")
        taken = written(taken.union(judged.where("fits").select("place", "resources")), "taken")
        undecided = written(judged.where("not fits and not full").select("place", "resources"), "undecided")
    return candidates.join(taken.select("place"), "place")


def _first(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows; no task sorts more than its own."""
    return rows.orderBy(*order).limit(n)


def _cross(entity_chunks: DataFrame, chunks: DataFrame, noise: DataFrame, target: int, per_chunk: int, per_entity: int, seed: int) -> DataFrame:
    """``place, entity, docs, chunk_ids``. A document has ``per_chunk`` uses for each of its chunks; its k-th use takes
    chunk k, round and round, in an order drawn by md5."""
    frequent = entity_doc_frequency(entity_chunks, chunks, noise)
    pairs = cross_document_pairs(entity_chunks, chunks, frequent, per_entity, seed)
    placed = pairs.select(F.concat_ws("|", _order(seed + 1, "entity", "doc_a", "doc_b"), "entity", F.col("doc_a").cast("string"), F.col("doc_b").cast("string")).alias("place"), "entity", F.array("doc_a", "doc_b").alias("resources"))
    candidates = written(_first(placed, 4 * target, "place"), "pairs")
    docs = candidates.select(F.explode("resources").alias("full_doc_id")).distinct()
    of = chunks.join(F.broadcast(docs), "full_doc_id", "left_semi").select("full_doc_id", "id")
    sizes = of.groupBy("full_doc_id").agg(F.count("*").alias("n"))
    chosen = _first(accepted(candidates, sizes.select(F.col("full_doc_id").alias("resource"), (F.col("n") * per_chunk).alias("units"))), target, "place")
    turn = F.row_number().over(Window.partitionBy("full_doc_id").orderBy("place")) - 1
    uses = chosen.select("place", F.posexplode("resources").alias("side", "full_doc_id")).withColumn("_k", turn).join(sizes, "full_doc_id")
    # A document is used at most as often as there are pairs, so no more of its chunks get a number.
    number = F.row_number().over(Window.partitionBy("full_doc_id").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "id")), "id"))
    numbered = of.withColumn("_n", number).where(F.col("_n") <= 4 * target)
    uses = uses.withColumn("_n", (F.col("_k") % F.col("n") + 1).cast("int")).join(numbered, ["full_doc_id", "_n"])
    sides = uses.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("side", "id"))).alias("_s"))
    return chosen.join(sides, "place").select("place", "entity", F.col("resources").alias("docs"), F.col("_s.id").alias("chunk_ids"))


def mine_dataset(
    chunks: DataFrame,
    entity_chunks: DataFrame,
    noise: DataFrame,
    disciplines: DataFrame,
    targets: dict[str, int],
    per_chunk: int = 3,
    per_entity: int = 2,
    per_discipline: int = 3,
    seed: int = 42,
) -> DataFrame:
    """``id, category, entities, doc_ids, chunk_ids, chunk_text, prompt``: what questions can be asked about.

    From chunks (id, full_doc_id, content), the entities of chunks (entity, chunk_id), entities that say nothing (noise:
    entity) and the documents of disciplines (full_doc_id). The categories come one after the other, each up to its
    target, and no chunk is used more than ``per_chunk`` times in all: pairs of documents that share an entity of 2 to 30
    documents (``per_entity`` pairs each, four times the target at most), chunks of disciplines (``per_discipline`` of a
    document), chunks of documents with two or more entities, and any chunk. Orders are drawn by md5 of the seed and the keys.
    Nulls: a chunk without id or document is never used, a text that is null is empty.
    """
    known = chunks.where("id is not null and full_doc_id is not null").select("id", "full_doc_id", F.coalesce("content", F.lit("")).alias("content"))
    goal = {c: max(targets.get(c, 0), 0) for c in CATEGORIES}
    pairs = written(_cross(entity_chunks, known, noise, goal["cross_document"], per_chunk, per_entity, seed), "cross")
    picked = written(pairs.select(F.lit("cross_document").alias("category"), "place", F.array("entity").alias("entities"), F.col("docs").alias("doc_ids"), "chunk_ids"), "picked")
    entities = doc_entities(entity_chunks, known, noise)
    for number, category in enumerate(CATEGORIES[1:], 2):
        used = picked.select(F.explode("chunk_ids").alias("id")).groupBy("id").agg(F.count("*").alias("_u")).where(F.col("_u") >= per_chunk)
        free = known.select("id", "full_doc_id").join(F.broadcast(used), "id", "left_anti")  # at most the sum of targets
        free = free.withColumn("place", F.concat_ws("|", _order(seed + number, "id"), "id")).withColumn("entities", F.array().cast("array<string>"))
        if category == "discipline":
            of_doc = F.row_number().over(Window.partitionBy("full_doc_id").orderBy("place"))
            free = free.join(bounded(disciplines.select("full_doc_id").distinct()), "full_doc_id", "left_semi").withColumn("_k", of_doc).where(F.col("_k") <= per_discipline)
        elif category == "conditional":
            free = free.drop("entities").join(entities, "full_doc_id")
        chosen = _first(free, goal[category], "place").select(F.lit(category).alias("category"), "place", "entities", F.array("full_doc_id").alias("doc_ids"), F.array("id").alias("chunk_ids"))
        picked = written(picked.union(chosen), "picked")
    return _items(picked, known)


def _items(picked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The picked items with their texts, each cut to 500 characters, and the prompt that asks for a question."""
    key = F.concat_ws("|", "category", F.concat_ws("|", "chunk_ids"), F.concat_ws("|", "entities"))
    items = picked.select(item_id("category", key).alias("item"), "category", "entities", "doc_ids", "chunk_ids")
    sides = items.select("item", F.posexplode("chunk_ids").alias("side", "id"))
    texts = chunks.join(F.broadcast(sides), "id").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("side", F.left("content", F.lit(500)).alias("text")))).alias("_t"))
    text = F.concat_ws("\n---\n", F.col("_t.text"))
    return items.join(texts, "item").select(F.col("item").alias("id"), "category", "entities", "doc_ids", "chunk_ids", text.alias("chunk_text"), _prompt(text).alias("prompt"))


def _prompt(text: Column) -> Column:
    about = F.when(F.size("entities") > 0, F.concat(F.lit(" about "), F.concat_ws(", ", "entities"))).otherwise("")
    return F.concat(F.lit("Ask one question of kind "), "category", about, F.lit(" that this text answers:\n"), text)
