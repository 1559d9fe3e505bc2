"""Benchmark decontamination by spaced seeds.

A seed is a mask of word positions within a short span: the hash of the words at the mask's positions ignores those
between, so a text with substituted words still meets the benchmark item wherever one mask falls on unchanged words.
Every hit fixes an alignment of document and item, along which the words are compared.

* Items of ten words and more have the masks of weight 6 and span at most 9, which were chosen by enumeration: whichever
  one or two words of 13 differ, and whichever one of 10, 11 or 12, one of the three fits between them.
* Items of seven, eight or nine words have three masks, each of which leaves out every third word, so one of them fits
  whichever one word differs.
* Shorter items have one mask of all their words.

An item is found where ``NEEDED`` of ``WINDOW`` consecutive words are equal, or of all its words if it has fewer, the
same share of them rounded up: one word may differ from seven words on, none below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskwise.llm.common import bounded, written

MASKS = ((0, 2, 3, 4, 6, 7), (0, 1, 2, 3, 6, 7), (0, 1, 3, 4, 6, 8))
#: Items of as many words have these masks; shorter ones have their own.
LONG = 10
WINDOW, NEEDED = 13, 11


def masks(size: int) -> dict[int, tuple[int, ...]]:
    """The masks of an item of so many words, by number; no two sizes share a number unless they share the mask."""
    if size >= LONG:
        return dict(enumerate(MASKS))
    if size >= 7:
        return {10 * size + k: tuple(i for i in range(size) if i % 3 != k) for k in range(3)}
    return {10 * size: tuple(range(size))}


def needed(size: Column) -> Column:
    """How many words of the best window of an item of so many words must be equal."""
    return F.when(size >= WINDOW, NEEDED).otherwise(F.ceil(size * NEEDED / WINDOW)).cast("int")


def words(text: str) -> Column:
    """Hashes of the text's words: runs of letters and digits, in lower case; none for a null text."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, tokens: str, chosen: dict[int, tuple[int, ...]]) -> DataFrame:
    """The rows' other columns with ``at``, a word's number, and ``seed``, one for each mask that fits from there on."""
    n, span = F.size(tokens), 1 + max(m[-1] for m in chosen.values())
    zipped = F.arrays_zip(*(F.slice(tokens, k + 1, F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(span)))
    keep = [c for c in rows.columns if c != tokens]
    each = rows.select(*keep, F.posexplode(zipped).alias("at", "w"))
    hashes = F.array(*(F.when(F.col(f"w.w{m[-1]}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"w.w{i}") for i in m))) for k, m in sorted(chosen.items())))
    return each.select(*keep, "at", F.explode(hashes).alias("seed")).where("seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """:func:`overlaps` with ``_h``, the hash of the document's text, as a written table.

    One scan of the texts finds the hits, which are made distinct before they are shuffled and are written; a second one
    reads the words of the documents that have any. The seeds of the benchmark, the keys of these documents and the
    items are broadcast while they are small. No text is shuffled unless over a million documents have a hit.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    items = written(benchmark.select("item_id", words("text").alias("item")).where(F.size("item") > 0), "items")
    # Which of the sizes below LONG there are: at most nine.
    sizes = sorted(r[0] for r in items.select(F.least(F.size("item"), F.lit(LONG)).alias("n")).distinct().collect())
    chosen: dict[int, tuple[int, ...]] = {}
    index = None
    for size in sizes or [LONG]:
        some = items.where(F.least(F.size("item"), F.lit(LONG)) == size)
        own = seeds(some, "item", masks(size))
        own = (own if size == LONG else own.where("at = 0")).select("item_id", "seed", F.col("at").alias("item_at"))
        chosen, index = chosen | masks(size), own if index is None else index.unionByName(own)
    hits = seeds(texts.select("doc_id", "_h", words("text").alias("doc")), "doc", chosen).join(bounded(index), "seed")
    hits = written(hits.groupBy("doc_id", "_h", "item_id", (F.col("at") - F.col("item_at")).alias("start")).agg(F.count("*").alias("n_seeds")), "hits")

    key = [F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")), F.col("d._h") == F.col("t._h")]
    once = hits.select("doc_id", "_h").distinct()
    read = texts.alias("t").join(bounded(once).alias("d"), key).select("d.doc_id", "d._h", F.col("t.text").alias("text")).dropDuplicates(["doc_id", "_h"])
    read = read.select("doc_id", "_h", words("text").alias("doc"))
    both = hits.alias("d").join(read.alias("t"), key).select("d.doc_id", "d._h", "d.item_id", "d.start", "t.doc")
    both = both.join(bounded(items, 4_000_000, F.size("item")), "item_id")
    first, last = F.greatest(F.lit(0), -F.col("start")), F.least(F.size("item"), F.size("doc") - F.col("start"))
    size = F.greatest(last - first, F.lit(0))
    equal = F.zip_with(F.slice("item", first + 1, size), F.slice("doc", first + F.col("start") + 1, size), lambda a, b: (a == b).cast("int"))
    window = F.least(F.lit(WINDOW), F.size("item"))
    ends = F.sequence(window, F.size("equal"))
    best = F.when(F.size("equal") >= window, F.array_max(F.transform(ends, lambda e: F.aggregate(F.slice("equal", e - window + 1, window), F.lit(0), lambda x, y: x + y)))).otherwise(0)
    found = both.withColumn("equal", equal).where(best >= needed(F.size("item")))
    found = found.select("doc_id", "_h", "item_id", "start", F.aggregate("equal", F.lit(0), lambda x, y: x + y).alias("n_matched"), F.size("item").alias("n_words"))
    top = found.groupBy("doc_id", "_h", "item_id", "n_words").agg(F.max(F.struct("n_matched", (-F.col("start")).alias("s"))).alias("b"))
    return written(top.select("doc_id", "_h", "item_id", F.col("b.n_matched").cast("long").alias("n_matched"), (-F.col("b.s")).cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words")), "contaminated")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_matched, start, n_words``: for each contaminated document and each item found in it, the
    best alignment: equal words, the document's word where the item would begin, and the item's length.

    Null or empty texts and items have no words and aren't found. Rows that repeat a doc_id and text count as one
    document; other texts of the same or a null doc_id are documents of their own, with rows of their own.
    """
    return contaminated(docs, benchmark).drop("_h")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = 4) -> DataFrame:
    """The rows of docs in whose text no item of at least ``shortest`` words is found; their columns stay as they are.

    Items of fewer words stand in any text, so they don't tell a copied benchmark; :func:`overlaps` reports them too.
    A row goes for its own text alone: others of its doc_id, or with a null doc_id as it has, stay.
    """
    found = contaminated(docs, benchmark).where(F.col("n_words") >= shortest).select(F.col("doc_id").alias("id"), F.col("_h").alias("h")).distinct()
    return docs.join(bounded(found), docs["doc_id"].eqNullSafe(found["id"]) & (F.xxhash64(docs["text"]) == found["h"]), "left_anti")


#: Eleven equal words of 13 hold a run of four, so the alignments of items of 13 words to compare are those of equal runs
#: of four; those of shorter items are all that have an equal word.
ORACLE = """
with d as (select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents where text is not null),
b as (select item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from benchmark),
dt as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from d),
bt as (select item_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos, len(w) as n from b),
dr as (select *, lead(word) over x as w1, lead(word, 2) over x as w2, lead(word, 3) over x as w3 from dt window x as (partition by doc_id order by pos)),
br as (select *, lead(word) over x as w1, lead(word, 2) over x as w2, lead(word, 3) over x as w3 from bt window x as (partition by item_id order by pos)),
dg as (select dr.doc_id, br.item_id, dr.pos - br.pos as start from dr join br using (word, w1, w2, w3) where n >= 13
  union select dt.doc_id, bt.item_id, dt.pos - bt.pos from dt join bt using (word) where n < 13),
e as (select dg.doc_id, dg.item_id, dg.start, bt.n, bt.pos, bt.word = dt.word as eq from dg join bt on bt.item_id = dg.item_id
  join dt on dt.doc_id = dg.doc_id and dt.pos = bt.pos + dg.start),
s as (select *, sum(eq::int) over (partition by doc_id, item_id, start order by pos rows between 12 preceding and current row) as k,
  sum(eq::int) over (partition by doc_id, item_id, start) as n_matched from e),
f as (select distinct doc_id, item_id, start, n, n_matched from s where k >= case when n < 13 then ceil(n * 11 / 13) else 11 end)
select doc_id, item_id, n_matched::bigint as n_matched, start::bigint as start, n::bigint as n_words
from (select *, row_number() over (partition by doc_id, item_id order by n_matched desc, start) as r from f) where r = 1
"""
