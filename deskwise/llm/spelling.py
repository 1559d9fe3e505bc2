"""Spelling variants of the words of a corpus: pairs one edit apart, and the form that each word is a variant of.

Asymmetric q-chunks. Of two words the shorter one contributes two disjoint chunks, its first and its second half; the
longer one, at most one code point longer, contributes positional grams of the same lengths. One edit lies in one half, so
the other is a gram of the longer word: the first half where it was, the second moved by the difference in length, which is
none or one. Only the grams at these places can join, and only they are emitted.

A chunk such as a common ending may stand in very many words. Pairs are formed within chunks of few words; in a chunk
of more, the rests of its words are cut into two chunks again, and so on down to rests of one letter, so that no large
group meets itself. Candidates are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskwise.llm.common import written

_RUN = re.compile("[a-zÀ-ÿA-Z]+")
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
NOISE = 97


def noisy_counts(docs: DataFrame, shortest: int = 5) -> DataFrame:
    """``word, n``: partial counts of the words of all texts, of ``shortest`` code points and more.

    A word is a run of Latin letters with A-Z lower-cased; where 97 divides the crc32 of ``<doc_id>:<run>`` it lacks one
    code point. Null texts have no words; a null doc_id is empty in that key.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for batch in batches:
            for doc_id, cell in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = (cell.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(_RUN.findall(text)).items():
                    code = zlib.crc32(run.encode(), start)
                    if code % NOISE == 0:
                        at = code % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= shortest:
                        held[run] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(counted, "word string, n long")


def _chunks(length: str, rest: str, longer: str) -> Column:
    """The two chunks of a rest, or its grams that can equal those of a rest one shorter (``longer``): what each leaves over, and
    the shorter rest's length then. ``length`` is the shorter rest's."""
    h = f"int({length} / 2)"
    return F.expr(
        f"array(struct(0 as k, substr({rest}, 1, {h}) as chunk, substr({rest}, {h} + 1) as rest, {length} - {h} as length), "
        f"struct(1 as k, substr({rest}, {h} + 1 + int({longer})) as chunk, substr({rest}, 1, {h} + int({longer})) as rest, {h} as length))"
    )


def near_pairs(words: DataFrame, most: int = 64) -> DataFrame:
    """``a, b, n_a, n_b``: every pair of distinct words that differ by one inserted, deleted or replaced code point, once,
    the shorter first.

    ``words`` has ``word, n``, each word once, of two code points or more. Groups of more than ``most`` words are cut further.
    """
    own = words.select("word", "n", F.lit(False).alias("longer"), F.length("word").alias("length"))
    grams = words.select("word", "n", F.lit(True).alias("longer"), (F.length("word") - 1).alias("length"))
    rows = own.union(grams).withColumn("rest", F.col("word")).withColumn("key", F.lit(0).cast("long"))
    found = None
    while True:
        parts = rows.select("word", "n", "longer", "key", F.explode(_chunks("length", "rest", "longer")).alias("c"))
        keyed = parts.select("word", "n", "longer", F.xxhash64("key", "c.k", "c.length", "c.chunk").alias("key"), "c.rest", "c.length")
        keyed = written(keyed, "chunks")
        sizes = keyed.groupBy("key").agg(F.count_if(~F.col("longer")).alias("short"), F.count("*").alias("all"), F.max("length").alias("least"))
        sizes = sizes.where("short >= 1 and all >= 2").withColumn("open", (F.col("all") > most) & (F.col("least") > 1))
        sizes = written(sizes.select("key", "open"), "chunk-sizes")
        small = keyed.join(sizes.where("not open").select("key"), "key")
        a = small.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = small.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
        pairs = a.join(b, "key").where("longer or a < b").select("a", "b", "n_a", "n_b").where(F.levenshtein("a", "b", 1) == 1)
        found = pairs if found is None else found.union(pairs)
        large = sizes.where("open").select("key")
        if large.isEmpty():
            return found.distinct()
        rows = keyed.join(large, "key")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word of ``forms`` (word, form) that has a form: the last word that forms lead to.

    Each round doubles the way that is known. A form is at least twice as frequent as its word, so ways end.
    """
    ways = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        ways = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ways


def variants(docs: DataFrame, least: int = 3, shortest: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``shortest`` code points that occurs ``least`` times.

    A word's form is its near word of largest count (ties: the smallest), if that occurs at least twice as often. Repeated
    rows count as often as they stand there; other columns don't matter; without words there are no rows.
    """
    words = written(noisy_counts(docs, shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")
    pairs = written(near_pairs(words), "near-words")
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    ways = ways.union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= 2 * F.col("n")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    told = written(told, "forms")
    found = told.join(roots(told), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows. Two words of equal length differ in one place if they are equal without it; else the shorter is the longer
#: without one letter. crc32 is computed byte by byte with its table.
ORACLE = """
with recursive tab as (
  select list_transform(range(256), lambda i: list_reduce([i::ubigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) as t
), runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents
), counted as (
  select run, hex(encode(concat(doc_id, ':', run))) as h, count(*) as n from runs group by doc_id, run
), coded as (
  select run, n, xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length(h) + 1, 2), lambda j: ('0x' || substr(h, j, 2))::ubigint)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255)::int + 1])), 4294967295::ubigint) as code from counted, tab
), noisy as (
  select case when code % 97 = 0 then substr(run, 1, (code % length(run))::int) || substr(run, (code % length(run))::int + 2) else run end as word, n from coded
), words as (
  select word, sum(n)::bigint as n from noisy where length(word) >= 5 group by word having sum(n) >= 3
), less as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1))::int as i from words)
), links as (
  select a.word, b.word as near, b.n as near_n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word
), ranked as (
  select word, near, near_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, near) as r from links
), forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * n then near end as form, case when near_n >= 2 * n then near_n end as form_n
  from words w left join ranked on ranked.word = w.word and r = 1
), chains as (
  select word, word as at from forms
  union all select c.word, f.form from chains c join forms f on f.word = c.at where f.form is not null
)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n from forms f join chains c on c.word = f.word join forms g on g.word = c.at and g.form is null
"""
