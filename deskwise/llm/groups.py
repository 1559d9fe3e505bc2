"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. Equal sets are one class. Shingles have one order for all documents, rare ones
first by a sketch of their frequencies; two sets of similarity 0.8 share one of the first fifth of either (the prefix).

* Similar documents are partitioned into groups: a document's group is its prefix shingle that most classes share, with
  the step of its size on a fine geometric scale, which makes bounds for the group tight.
* The matrix has a row for each shingle and group: the union of the prefixes of the group's members.
* A document's overlap with a group is counted in the matrix. It bounds the overlap with each member, so a group whose
  bound is too low for every possible member isn't opened.
* A group that qualifies is opened at its most typical members first. Then, for the documents that are still apart from
  some of its members, it is opened for these members: those that share one of the document's rarest tokens, as many as
  the bound of the group asks for. Each pair that its own bound allows is compared.

Two documents are only compared if each opened the other's group. Pairs that are known to be connected aren't compared
again, so a large group of copies costs one comparison a member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskwise.llm import shingles
from deskwise.llm.common import bounded, components, salted, written

#: From texts to the sorted distinct 64-bit hashes of each one's set.
Sets = Callable[[list], Iterator[np.ndarray]]

#: The ratio of the steps of sizes.
STEP = 1.03
#: log2 of the number of counters of the sketch, and of the slices in which it is summed.
SKETCH, SLICES = 20, 6


def _needed(n: Column) -> Column:
    """Shingles that a set of n shares at least with any set of similarity 0.8."""
    return F.floor((4 * n + 4) / 5)


def _least(n: Column, m: Column) -> Column:
    """Shared prefix tokens of sets of n and m elements whose similarity is 0.8."""
    return F.ceil(F.lit(4) * (n + m) / 9 - 1e-9) - F.greatest(_needed(n) - 1, _needed(m) - 1)


def _group_least(n: Column, small: Column, large: Column) -> Column:
    """The least of this for any m from small to large.

    It grows with m up to n. From there on it falls, but rises by one where rounding up lets ``_needed`` stand still,
    which it does at every fifth m; so the least is at the large end or right before it.
    """
    return F.least(_least(n, F.least(small, n)), _least(n, F.greatest(large, n)), _least(n, F.greatest(large - 1, n)))


def frequencies(docs: DataFrame, sets: Sets = shingles.sets) -> np.ndarray:
    """How many elements of all documents' sets have a hash of each prefix of SKETCH bits.

    Its size is fixed. Tasks send their counts in slices, which are added up in two rounds.
    """
    per = 1 << SKETCH - SLICES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << SKETCH, np.int64)
        for batch in batches:
            for found in sets(batch["text"].to_pylist()):
                np.add.at(total, found >> np.uint64(64 - SKETCH), 1)
        some = TaskContext.get().partitionId() % 64
        blobs = [total[k * per : (k + 1) * per].astype("<i8").tobytes() for k in range(1 << SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(1 << SLICES), pa.int32()), pa.array([some] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "some", "counts"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), "<i8") for b in rows["counts"])
        return pa.table({"slice": rows["slice"][:1], "some": rows["some"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "slice int, some int, counts binary"
    parts = docs.select("text").mapInArrow(counted, kind).groupBy("slice", "some").applyInArrow(added, kind)
    slices = parts.groupBy("slice").applyInArrow(added, kind).collect()
    total = np.zeros(1 << SKETCH, np.int64)
    for r in slices:
        total[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(r["counts"], "<i8")
    return total


def prefixes(docs: DataFrame, sets: Sets = shingles.sets) -> DataFrame:
    """``row, doc_id, th, n, d1, d2, prefix``: the size, digest and first elements of each document's set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, sets).astype(np.uint32))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for batch in batches:
            n, d1, d2, prefix = [], [], [], []
            for found in sets(batch["text"].to_pylist()):
                order = np.lexsort((found, often[found >> np.uint64(64 - SKETCH)]))
                n.append(len(found))
                d1.append(shingles.mix(found).sum(dtype=np.uint64).astype(np.int64))
                d2.append(shingles.mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
                prefix.append(found[order[: len(found) - (4 * len(found) + 4) // 5 + 1]].astype(np.int64) if len(found) else np.zeros(0, np.int64))
            arrays = [batch["row"], batch["doc_id"], batch["th"], pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "th", "n", "d1", "d2", "prefix"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(first, "row long, doc_id long, th long, n long, d1 long, d2 long, prefix array<long>")


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, sets: Sets = shingles.sets) -> DataFrame:
    """The pairs (u, v) whose sets have similarity 0.8, by comparing their texts.

    ``nodes``: node, doc_id, th. Each text travels to the pairs it belongs to; a text of many pairs is split by size.
    """
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node")
    wanted = wanted.select("node", F.coalesce("doc_id", F.lit(0)).alias("_id"), "th")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64("text").alias("th"), "text")
    texts = written(texts.join(bounded(wanted), ["_id", "th"]).select("node", "text").dropDuplicates(["node"]), "texts")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            keep = []
            for u, v, x, y in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), batch["a"], batch["b"], strict=True):
                if held[0] != v:
                    held = v, next(iter(sets([y.as_py()])))
                a, b = next(iter(sets([x.as_py()]))), held[1]
                same = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * same >= 80 * (len(a) + len(b) - same):
                    keep.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in keep], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return written(both.mapInArrow(similar, "u long, v long"), "linked")


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and the component it is known to be in."""
    found = components(links)
    return nodes.join(bounded(found), "node", "left").withColumn("component", F.coalesce("component", "node"))


def labelled(docs: DataFrame, sets: Sets = shingles.sets) -> DataFrame:
    """``doc_id, th, n_shingles, label`` of every row: rows that links of similarity 0.8 connect have one label.

    ``th`` is the hash of the text. Texts that are null or without words have no shingles and are linked with nothing.
    ``sets`` gives the sets to be compared; they are the word shingles unless it is another function of the text.
    """
    rows = written(prefixes(docs, sets), "shingle-sets")
    classes = written(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.count("*").alias("copies")).where("copies > 1").select("d1", "d2", "node"), "classes")
    copies = written(salted(rows.select("d1", "d2", "row"), classes, ["d1", "d2"], "row").where("row <> node").select("row", "node"), "copies")
    apart = rows.where("n > 0").join(bounded(copies.select("row")), "row", "left_anti").withColumnRenamed("row", "node")

    tokens = apart.select("node", F.explode("prefix").alias("token"))
    several = written(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "shared-shingles")
    shared = written(tokens.join(several, "token"), "prefixes")

    # Groups: the most shared token of each document's prefix; typical: how widely its tokens are shared.
    nodes = shared.groupBy("node").agg(F.max(F.struct("often", "token")).alias("g"), F.sum("often").alias("typical"))
    nodes = nodes.select("node", "g.token", "typical").join(apart.select("node", "doc_id", "th", "n"), "node")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(STEP)))
    nodes = written(nodes.withColumn("group", F.xxhash64("token", step)).drop("token"), "nodes")
    placed = written(shared.select("node", "token", "often").join(nodes.select("node", "group"), "node"), "placed")
    matrix = written(placed.groupBy("token", "group").agg(F.count("*").alias("members")), "token-groups")
    sizes = nodes.groupBy("group").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.struct("typical", (-F.col("node")).alias("node"))).alias("top"))
    sizes = sizes.select("group", "lo", "hi", (-F.col("top.node")).alias("leader"))

    # The overlap of each document with each group that has one of its tokens; in its own group with other members.
    met = placed.select("node", "token", F.col("group").alias("own")).join(matrix, "token").where("group <> own or members > 1")
    overlap = met.groupBy("node", "group").agg(F.count("*").alias("overlap"))
    overlap = salted(overlap.join(nodes.select("node", "n"), "node"), sizes, "group", "node")

    n = F.col("n")
    small, large = F.greatest("lo", _needed(n)), F.least("hi", F.floor(n * 5 / 4))
    least = F.greatest(_group_least(n, small, large), F.lit(1))
    opened = overlap.where((small <= large) & (F.col("overlap") >= least))
    opened = written(opened.select("node", "group", "n", "leader", least.cast("int").alias("least")), "opened-groups")

    def compared(pairs: DataFrame) -> DataFrame:
        """The links among pairs (u, v), comparing the texts only where sizes and common prefix tokens allow one."""
        size = nodes.select("node", "n")
        sized = pairs.join(size.select(F.col("node").alias("u"), F.col("n").alias("a")), "u").join(size.select(F.col("node").alias("v"), F.col("n").alias("b")), "v")
        a, b = F.col("a"), F.col("b")
        sized = sized.where((a >= _needed(b)) & (b >= _needed(a))).select("u", "v", _least(a, b).alias("needed"))
        both = sized.join(tokens_of.select(F.col("node").alias("u"), F.col("tokens").alias("x")), "u").join(tokens_of.select(F.col("node").alias("v"), F.col("tokens").alias("y")), "v")
        near = both.where(F.size(F.array_intersect("x", "y")) >= F.col("needed")).select("u", "v")
        return linked(written(near, "pairs-to-compare"), nodes, docs, sets)

    in_order = F.sort_array(F.collect_list(F.struct("often", "token")))["token"]
    tokens_of = written(placed.groupBy("node").agg(in_order.alias("tokens")), "tokens")
    ordered = (F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))
    stars = written(opened.where("node <> leader").withColumn("other", F.col("leader")).select(*ordered).distinct(), "stars")
    links = compared(stars)

    # Members of an opened group that opened the document's own, and aren't yet connected with it. Of the two sides of a
    # pair the one of the later component looks for the other.
    label = _labels(nodes.select("node", F.col("group").alias("own")), links)
    sides = written(opened.select("node", "group", "n", "least").join(label, "node"), "sides")
    kinds = sides.select(F.col("own").alias("group"), F.col("group").alias("own"), F.col("component").alias("met")).distinct()
    again = written(sides.join(kinds, ["group", "own"]).where("component > met"), "groups-again")
    members = sides.select(F.col("own").alias("group"), F.col("group").alias("own"), F.col("component").alias("met"), "node", "n", "least")
    members = members.join(again.select("group", "own", "met").distinct(), ["group", "own", "met"])

    def first(side: DataFrame, *names: str) -> DataFrame:
        """Of each row the tokens, rarest first, one of which any pair with ``least`` common tokens shares, and how many
        of its tokens are left from there on."""
        size = F.size("tokens")
        found = side.join(tokens_of, "node").select("group", "own", "met", "node", "n", size.alias("size"), F.posexplode(F.slice("tokens", F.lit(1), F.greatest(size - F.col("least") + 1, F.lit(0)))).alias("place", "token"))
        node, m, left = names
        return found.select("group", "own", "met", "token", F.col("node").alias(node), F.col("n").alias(m), (F.col("size") - F.col("place")).alias(left))

    m = F.col("m")
    one, two = first(again, "node", "n", "left").alias("one"), first(members, "other", "m", "rest").alias("two")
    keys = [F.col(f"one.{c}") == F.col(f"two.{c}") for c in ("group", "own", "met", "token")]
    allowed = (m >= _needed(n)) & (n >= _needed(m)) & (F.least("left", "rest") >= _least(n, m))
    pairs = one.join(two, [*keys, allowed])
    more = compared(written(pairs.select(*ordered).distinct().join(stars, ["u", "v"], "left_anti"), "pairs"))

    found = written(components(links.union(more)), "components")
    each = rows.select("row", "doc_id", "th", "n").join(bounded(copies), "row", "left").withColumn("node", F.coalesce("node", "row"))
    return written(each.join(bounded(found), "node", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("label")), "labelled")


def least_ids(docs: DataFrame, sets: Sets = shingles.sets) -> DataFrame:
    """:func:`similar_components` with ``th``, the hash of each row's text."""
    rows = labelled(docs, sets)
    least = written(rows.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k"), "least-ids")
    found = rows.join(bounded(least), "label", "left")
    return found.select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def similar_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the least doc_id that links of similarity 0.8 reach.

    Rows that repeat a doc_id stay rows of their own; a component of null ids alone has a null id. An empty table has
    no rows.
    """
    return least_ids(docs).drop("th")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each component the row of the least doc_id, and then text hash, stays.

    Of rows that repeat a doc_id and text one stays. Texts without words stay. All columns stay, whatever their names.
    """
    rows = labelled(docs)
    first = rows.where("n_shingles > 0").groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("r"))
    first = first.select(F.coalesce("r.doc_id", F.lit(-(1 << 63))).alias("id"), F.col("r.th").alias("th"))
    keyed = docs.select(F.struct("*").alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th"))
    worded = F.coalesce(F.col("own.text").rlike(r"[^ \t-\r]"), F.lit(False))
    stay = keyed.where(worded).join(first, ["id", "th"]).dropDuplicates(["id", "th"])
    return stay.unionByName(keyed.where(~worded)).select(*(F.col("own").getField(c).alias(c) for c in docs.columns))
