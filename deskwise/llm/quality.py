"""Quality rules: counts that anyone can check, and the likelihood of a text under trusted and under raw documents.

Words and pairs of adjacent words are hashed to a fixed number of buckets. Two multinomials over the buckets are counted,
one over all documents and one over the trusted ones; each is smoothed in proportion to its size, so a bucket's weight is
``ln((t + 10) / (e + 10))`` for t occurrences in trusted documents where e were expected. A text's score is the mean weight
of its words and pairs, so it doesn't depend on the length. Weights are whole thousandths: sums are exact in any order, and
a document is kept or not by one comparison, with no sampling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.llm.common import bounded

#: Buckets of hashed words and pairs; also the most rows that come to the driver.
BUCKETS = 65521
PAIR = 65599
#: Pseudo-counts of a bucket: what few occurrences say of a bucket is held back, so that a small corpus judges less, not otherwise.
PRIOR = 10
#: The least mean weight, in thousandths, of a text that is kept.
LEAST = -100
#: Different words that a task remembers between texts.
HELD = 500_000
LOT = 1 << 20


class _Words(dict):
    """The number of each word, and its hash in the lower 28 bits."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) << 28 | int(hashlib.md5(word).hexdigest()[:7], 16)
        return found


class _Reader:
    """Texts as numbers and hashes of their words; what is remembered is bounded, but for the words of one text."""

    def __init__(self) -> None:
        self.words = _Words()

    def read(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word (equal for equal words), and the buckets of all words and pairs."""
        if len(self.words) > HELD:
            self.words.clear()
        found = raw.split()
        codes = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        h = codes & ((1 << 28) - 1)
        return codes >> 28, np.concatenate([h, h[:-1] * PAIR + h[1:]]) % BUCKETS


def _repeated(ids: np.ndarray) -> int:
    """How many words stand in windows of three that the text has twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    most = int(ids.max()) + 1
    _, pair = np.unique(ids[:-1] * most + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * most + ids[2:], return_inverse=True, return_counts=True)
    if len(count) == n - 2:
        return 0
    again = count[window] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def _raw(cell: pa.Scalar) -> tuple[str, bytes]:
    text = cell.as_py() or ""
    return text, text.encode("utf-8", "surrogatepass")


def trusted(labels: DataFrame) -> DataFrame:
    """``doc_id, trusted``: the documents whose labels all say good and not toxic; a null doc_id or label isn't trusted."""
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return told.where("q = 1 and t = 0").select("doc_id", F.lit(True).alias("trusted"))


def weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The weight of each bucket, in thousandths, from every document and every label.

    Tasks count all their texts before anything is shuffled, so a task sends each bucket once. Without trusted documents
    all weights are 0.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = _Reader(), np.zeros((2, BUCKETS), np.int64)
        lots: list[list[np.ndarray]] = [[], []]
        held = 0

        def add() -> None:
            for row, lot in zip(sums, lots, strict=True):
                if lot:
                    row += np.bincount(np.concatenate(lot), minlength=BUCKETS)
                    lot.clear()

        for batch in batches:
            for cell, good in zip(batch["text"], batch["trusted"].to_pylist(), strict=True):
                _, buckets = reader.read(_raw(cell)[1])
                lots[0].append(buckets)
                if good:
                    lots[1].append(buckets)
                held += len(buckets)
                if held > LOT:
                    add()
                    held = 0
        add()
        there = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(sums[0][there]), pa.array(sums[1][there])], names=["bucket", "raw", "good"])

    marked = docs.select("doc_id", "text").join(bounded(trusted(labels)), "doc_id", "left").select("text", "trusted")
    found = marked.mapInArrow(counted, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.sum():
        return np.zeros(BUCKETS, np.int64)
    return np.floor(1000 * np.log((good + PRIOR) / (raw * good.sum() / raw.sum() + PRIOR)) + 0.5).astype(np.int64)


def judged(docs: DataFrame, weight: np.ndarray, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, weight_sum, n_grams`` of every row.

    A document fails the base with fewer than 50 words, or if more than half of them stand in repeated windows of three;
    else it is kept if its mean weight is ``least`` thousandths or more. Null, empty and blank texts have no words and fail.
    Rows that repeat a doc_id are judged one by one; the columns of the table other than doc_id and text don't matter.
    """
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept weight_sum n_grams".split()
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            out = []
            for doc_id, cell in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text, raw = _raw(cell)
                ids, buckets = reader.read(raw)
                n, again = len(ids), _repeated(ids)
                spaces = sum(map(text.count, " \t\n\v\f\r"))
                lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
                failed = n < 50 or 100 * again > 50 * n
                total = int(weight[buckets].sum())
                out.append((doc_id, n, len(text) - spaces, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), again, failed, not failed and total >= least * len(buckets), total, len(buckets)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = ", ".join(f"{c} {'boolean' if k == pa.bool_() else 'long'}" for c, k in zip(names, kinds, strict=True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(told, schema)


#: The same rows: words, windows and lines by splitting, weights by counting buckets.
ORACLE = rf"""
with docs as (
  select doc_id, coalesce(text, '') as text, row_number() over () as row from documents
), texts as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from docs
), placed as (
  select row, doc_id, unnest(words) as w, unnest(range(1, len(words) + 1)) as i from texts
), hashed as (
  select row, doc_id, w, i, ('0x' || substr(md5(w), 1, 7))::bigint as h from placed
), nexts as (
  select *, lead(w) over o as w2, lead(w, 2) over o as w3, lead(h) over o as h2 from hashed window o as (partition by row order by i)
), windows as (
  select row, i, count(*) over (partition by row, w, w2, w3) as n from nexts where w3 is not null
), repeats as (
  select row, count(distinct i + k)::bigint as n from windows, range(3) as r(k) where n > 1 group by row
), grams as (
  select row, doc_id, h % {BUCKETS} as bucket from nexts
  union all select row, doc_id, (h * {PAIR} + h2) % {BUCKETS} from nexts where h2 is not null
), good as (
  select doc_id, true as trusted from labels group by doc_id having min(quality) = 1 and max(toxic) = 0
), counts as (
  select bucket, count(*)::double as raw, count(trusted)::double as good from grams left join good using (doc_id) group by bucket
), sums as (
  select sum(raw) as raws, sum(good) as goods from counts
), weights as (
  select bucket, case when goods = 0 then 0 else floor(1000 * ln((good + {PRIOR}) / (raw * goods / raws + {PRIOR})) + 0.5) end::bigint as weight from counts, sums
), scores as (
  select row, sum(weight)::bigint as weight_sum, count(*) as n_grams from grams join weights using (bucket) group by row
), lines as (
  select row, line, count(*) - 1 as n from (select row, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]') group by row, line
), dups as (
  select row, sum(n)::bigint as n from lines group by row
), told as (
  select doc_id, len(words) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(d.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(weight_sum, 0) as weight_sum, coalesce(n_grams, 0) as n_grams
  from texts left join repeats r using (row) left join scores using (row) left join dups d using (row)
)
select * exclude (failed), failed as base_failed, not failed and weight_sum >= {LEAST} * n_grams as kept
from (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as failed from told)
"""
