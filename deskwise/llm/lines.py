"""Line dedup by a deletion-neighbourhood join on words.

Two lines are near if one word was substituted, inserted or left out. A line emits the hash of itself with each word
left out and of itself split at each place: lines that share one of these have the same words before and after it, with
at most one word between, so all lines of a key are near each other and the earliest of a key stands for it.

A line of n words has 2n + 1 such keys, too many for every line of a corpus. One edit leaves the first or the last c
words as they were, c being at most half of either line. So only lines that share such a piece with another go on, with
the words beside it; of these a shared piece is sought in the same way, until few words are left, and only these emit keys. A line near one
other has few keys, however long it is; one that shares pieces everywhere with others has about as many as words.

Every line that isn't blank is compared as it is. The edit bound is a fifth of the line, as for other near duplicates
(a similarity of 0.8): lines of five words and more are compared by one edit, and for shorter ones the bound is none, or
"Chapter one" would take away "Chapter two".

Documents have one order, by doc_id and a hash of the text, in one number. It needn't be free of collisions: a line is
told by its place and its own hash, so texts of one doc_id whose numbers are equal don't lose lines to each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskwise.llm.common import salted, written

#: Removes white space around a line; words are what stands between runs of it.
_SPACE = " \t\r\f\v"
_NINE = 1_000_000_000
#: Beside a shared piece of more words, a shared piece is sought again before keys are emitted.
_FEW = 8


def _document() -> Column:
    """The order of documents, doc_id and then a hash of the text, as one number; a null id is the least."""
    order = F.coalesce("doc_id", F.lit(-(1 << 63))).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return (order.cast("decimal(21,0)") * F.lit(_NINE).cast("decimal(10,0)") + F.pmod(F.xxhash64("text"), F.lit(_NINE))).cast("decimal(31,0)")


def _place(document: Column, line: Column) -> Column:
    return (document * F.lit(_NINE).cast("decimal(10,0)") + line).cast("decimal(38,0)")


def _trimmed(line: Column) -> Column:
    ends = reduce(lambda p, q: p | q, [end(space) for space in _SPACE for end in (line.startswith, line.endswith)])
    return F.when(ends, F.btrim(line, F.lit(_SPACE))).otherwise(line)


def _plain(line: Column) -> Column:
    """The line's words with one blank between any two. Few lines have other white space."""
    odd = reduce(lambda p, q: p | q, [line.contains(space) for space in ("  ", *_SPACE[1:])])
    return F.when(odd, F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")).otherwise(line)


def _n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _first(line: Column, n: Column) -> Column:
    """The first n words of a plain line; the last -n if n is negative."""
    return F.call_function("substring_index", line, F.lit(" "), n)


def _piece(n: Column) -> Column:
    """How many words the pieces of a line of n words have: half of them, rounded down so that few n differ in this from
    n - 1."""
    half = lambda by: F.shiftleft(F.shiftright(n, by + 1), by)
    return F.when(n < 16, half(0)).when(n < 32, half(1)).when(n < 64, half(2)).otherwise(half(3))


def _pieces(within: Column, line: Column, n: Column, rest: bool = False) -> Column:
    """Keys of a line's first and last words, in those that share ``within``, each with the words beside them if
    ``rest``. Two lines of which one edit makes the other share one of these: the longer one also has pieces as long as
    those of a line of a word less."""

    def ends(c: Column) -> list[Column]:
        keys = [F.xxhash64(within, F.lit(0), _first(line, c)), F.xxhash64(within, F.lit(1), _first(line, -c))]
        return [F.struct(k.alias("key"), w.alias("rest"), c.alias("size")) for k, w in zip(keys, [_first(line, c - n), _first(line, n - c)])] if rest else keys

    return F.when(_piece(n) == _piece(n - 1), F.array(*ends(_piece(n)))).otherwise(F.array(*ends(_piece(n)), *ends(_piece(n - 1))))


def _deletions(within: str, line: str) -> Column:
    """The line split at each place i, and with each word i left out: hashes of what stands before and after; rows of
    ``i`` from 0 to 2n."""
    n, i = F.col("n"), F.col("i")
    before, after = F.when(i <= n, i).otherwise(i - n - 1), F.when(i <= n, n - i).otherwise(2 * n - i)
    return F.xxhash64(within, _first(F.col(line), before), _first(F.col(line), -after))


def _one_edit(a: str, b: str) -> Column:
    """Whether word arrays are equal but for one substituted, inserted or missing word."""

    def same(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(at == 0, longest).otherwise(at - 1)

    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (same(F.col(a), F.col(b)) + same(F.reverse(a), F.reverse(b)) >= longest - 1)


def _shared(rows: DataFrame, line: str) -> DataFrame:
    """The rows whose ``key`` another line has too."""
    keys = rows.groupBy("key").agg(F.min(line).alias("a"), F.max(line).alias("b")).where("a < b").select("key")
    return salted(rows, keys, "key", line)


def _beside(rows: DataFrame, line: str, words: str) -> DataFrame:
    """``line``, the ``key`` and ``size`` of each piece of ``words`` within the row's ``key``, and the ``rest`` of the words."""
    found = rows.withColumn("n", _n_words(F.col(words))).select(line, F.explode(_pieces(F.col("key"), F.col(words), F.col("n"), rest=True)).alias("p"))
    return found.select(line, "p.*")


def repeated(docs: DataFrame, min_words: int = 1, near_words: int = 5) -> DataFrame:
    """``document, line, k1``: every line that repeats an earlier one, as numbers of the document and of the line in it
    and the line's hash.

    Lines of ``min_words`` words are compared as they are, without the white space around them; lines of ``near_words``
    also by one edit. Earlier: in the order of doc_id (null first), text hash and line. Blank lines repeat nothing.
    """
    texts = docs.where("text <> ''").select(_document().alias("document"), "text")
    split = texts.select("document", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    split = split.select("document", "line", _trimmed(F.col("t")).alias("t")).where("t <> ''").withColumn("u", _plain(F.col("t"))).withColumn("n", _n_words(F.col("u")))
    if min_words > 1:
        split = split.where(F.col("n") >= min_words)
    halves = F.when(F.col("n") >= near_words, _pieces(F.lit(0).cast("long"), F.col("u"), F.col("n")))
    lines = written(split.select(_place(F.col("document"), F.col("line")).alias("place"), F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(7), "t").alias("k2"), halves.alias("halves")), "lines")

    first = written(lines.groupBy("k1", "k2").agg(F.min("place").alias("first"), F.count("*").alias("n")), "first-lines")
    exact = salted(lines.select("k1", "k2", "place"), first.where("n > 1").select("k1", "k2", "first"), ["k1", "k2"], "place").where("place > first").select("place", "k1")

    half = lines.where("halves is not null").select(F.explode("halves").alias("key"), "k1")
    half = written(_shared(half, "k1").distinct(), "shared-halves")
    some = half.select("k1").distinct().join(first, "k1").select(F.col("first").alias("place"), "k1")
    some = some.select(F.expr(f"cast(floor(place / {_NINE}BD) as decimal(31,0))").alias("document"), F.expr(f"cast(place % {_NINE}BD as int)").alias("line"), "place", "k1")
    wanted = some.groupBy("document").agg(F.collect_list(F.struct("line", "place", "k1")).alias("wanted"))
    source = texts.withColumn("th", F.xxhash64("text")).join(wanted, "document").dropDuplicates(["document", "th"])
    # The array around the lines has them split once for a text, not once for each line that is taken.
    near = source.select("wanted", F.explode(F.array(F.split("text", "\n"))).alias("all")).select(F.explode("wanted").alias("x"), "all")
    near = near.select("x.place", "x.k1", F.btrim(F.get("all", F.col("x.line")), F.lit(_SPACE)).alias("t"))
    near = written(near.where(F.xxhash64("t") == F.col("k1")).select("place", "k1", _plain(F.col("t")).alias("u")), "near-lines")

    parts = _beside(near.withColumn("key", F.lit(0).cast("long")), "k1", "u")
    parts, short = written(parts.join(half, ["k1", "key"]), "parts"), []
    while True:
        # Lines that share a piece have its size in common, so those near each other go the same way.
        short.append(parts.where(F.col("size") <= _FEW).select("k1", "key", "rest"))
        if (more := parts.where(F.col("size") > _FEW)).isEmpty():
            break
        parts = written(_shared(_beside(more, "k1", "rest"), "k1"), "parts")
    rests = reduce(DataFrame.union, short).withColumn("n", _n_words(F.col("rest")))
    keys = rests.select("k1", "key", "rest", "n", F.explode(F.sequence(F.lit(0), 2 * F.col("n"))).alias("i"))
    keys = written(keys.select("k1", _deletions("key", "rest").alias("key")), "deletions")
    variants = written(_shared(keys, "k1").join(near.select("k1", "place"), "k1").select("key", "place"), "equal-deletions")
    earliest = variants.groupBy("key").agg(F.min("place").alias("first"))
    pairs = salted(variants, earliest, "key", "place").where("place > first").groupBy("place").agg(F.min("first").alias("first"))
    near = near.withColumn("w", F.split("u", " ")).drop("u")
    checked = pairs.join(near.withColumnRenamed("w", "a"), "place").join(near.select(F.col("place").alias("first"), F.col("w").alias("b")), "first").where(_one_edit("a", "b"))
    # A line that is near an earlier one goes, and so do its exact repeats, which are gone already.
    both = exact.union(checked.select("place", "k1"))
    return both.select(F.expr(f"cast(floor(place / {_NINE}BD) as decimal(31,0))").alias("document"), F.expr(f"cast(place % {_NINE}BD as int)").alias("line"), "k1")


def without_repeated(docs: DataFrame, min_words: int = 1, near_words: int = 5) -> DataFrame:
    """The documents with every line left out that repeats an earlier one; adds ``n_lines`` and ``n_removed``.

    The other lines stay as they are. Null and empty texts stay too. Rows that repeat a doc_id and text are one
    document: each keeps the same lines. Columns of the two names are replaced; all others stay, whatever their names.
    """
    gone = repeated(docs, min_words, near_words).groupBy("document").agg(F.collect_set(F.struct("line", "k1")).alias("gone"))
    docs = docs.drop("n_lines", "n_removed")
    rows = docs.select(F.struct("*").alias("own"), _document().alias("document")).join(gone, "document", "left")
    rows = rows.withColumn("lines", F.split("own.text", "\n"))
    repeats = F.filter("gone", lambda x: F.xxhash64(F.btrim(F.get("lines", x["line"]), F.lit(_SPACE))) == x["k1"])
    rows = rows.withColumn("cut", F.coalesce(F.transform(repeats, lambda x: x["line"]), F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "cut"), lambda i: F.get("lines", i))
    text = F.when(F.size("cut") == 0, F.col("own.text")).otherwise(F.array_join(kept, "\n"))
    columns = [(text if c.lower() == "text" else F.col("own").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*columns, F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.size("cut").cast("long").alias("n_removed"))
