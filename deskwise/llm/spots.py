"""Document fingerprints by spot signatures: an anchor and the chain of content words that follow it.

Anchors are the common words, the start of a text, and the content words whose hash ends in four zero bits, so that texts
without a listed common word have signatures too and no text changes its kind of signatures with its length. A chain is
the next two content words, or as many as the text still has. A fingerprint is the whole set of signatures, 48 bits each,
so the likeness of two fingerprints is the exact Jaccard similarity of the sets.

Near duplicates (:func:`near_classes`) are found without comparing every two fingerprints. Sets are partitioned by their length (steps of 3 %)
and the rarest of their signatures that others share; pairs are pruned by their lengths and by how many of their rarest
signatures they have in common, and the Jaccard similarity of the rest is computed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskwise.llm import groups
from deskwise.llm.common import partitions
from deskwise.llm.shingles import mix

#: Common words of English, French, German and Spanish, the anchors.
ANCHORS = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "au aux avec ce de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als am auf aus das dem den der des die ein eine er es für im ist mit nicht sich sie und von zu "
    "al como con de del el ella en es esta la las lo los más no para pero por que se su un una y".split()
)
CHAIN = 2
#: Characters of text whose signatures are computed at once.
LOT = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
_EVERY = np.uint64(0b11110)  # a content word is an anchor where these bits of its hash are 0
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, CHAIN + 3, np.uint64) * np.uint64(2) + np.uint64(1)
_START = np.uint64(0x5851F42D4C957F2D)


class _Codes(dict):
    """The hash of a word, its last bit being whether it's a common one. Frequent words are remembered."""

    most = 500_000

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1 | (word in ANCHORS)
        if len(self) < self.most:
            self[word] = code
        return code


_codes = _Codes()


def _signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of all texts and the text of each, in order of both, each once."""
    words: list[str] = []
    counts = []
    for text in texts:
        found = _WORD.findall(text.lower())
        words += found
        counts.append(len(found))
    count = np.array(counts, np.int64)
    code = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    doc = np.repeat(np.arange(len(texts)), count)
    common = code & np.uint64(1) == 1
    content = np.flatnonzero(~common)
    before = np.cumsum(~common) - ~common  # content words before each word
    first = (np.cumsum(count) - count)[count > 0]
    marked = np.flatnonzero(~common & (code & _EVERY == 0))
    common = np.flatnonzero(common)
    at = np.concatenate([first, common, marked])
    of, follows = doc[at], np.concatenate([before[first], before[common], before[marked] + 1])
    h = np.concatenate([np.full(len(first), _START), code[common], code[marked]]) * _FACTORS[0]
    for k in range(CHAIN if len(content) else 0):
        j = np.minimum(follows + k, len(content) - 1)
        there = (follows + k < len(content)) & (doc[content[j]] == of)
        h += np.where(there, mix(code[content[j]]) * _FACTORS[k + 1], np.uint64(0))
    # A text without words, unless it's empty, has one signature, its own hash.
    bare = [i for i, text in enumerate(texts) if text and not count[i]]
    own = np.array([xxhash.xxh3_64_intdigest(texts[i].encode("utf-8", "surrogatepass")) for i in bare], np.uint64) * _FACTORS[-1]
    h, of = mix(np.concatenate([h, own])) >> np.uint64(16) << np.uint64(16), np.concatenate([of, np.array(bare, np.int64)])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[keep], of[keep]


def sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted signatures of each text, 48 bits at the upper end of 64; none for a null or empty text."""
    lot: list[str] = []
    size = 0

    def each() -> Iterator[np.ndarray]:
        found, of = _signatures(lot)
        yield from np.split(found, np.searchsorted(of, np.arange(1, len(lot))))

    for text in texts:
        if lot and size + len(text or "") > LOT:
            yield from each()
            lot, size = [], 0
        lot.append(text or "")
        size += len(text or "")
    if lot:
        yield from each()


def fingerprint(found: np.ndarray) -> str:
    """A set of signatures as text, eight characters each, in order."""
    return base64.b64encode(found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """The Jaccard similarity of the signature sets of two fingerprints; two empty ones are alike."""
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same) if len(a) or len(b) else 1.0


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, th, n_signatures, near_id`` of every row: the hash of its text, the size of its set, and the least doc_id
    that links of signature sets of Jaccard similarity 0.8 reach, itself included. Empty sets are linked with nothing."""
    return groups.least_ids(docs, sets).withColumnsRenamed({"n_shingles": "n_signatures", "component_id": "near_id"})


_ROW = "bucket int, ahead boolean, key long, th long, kind int, doc_id long, near_id long, size long, packed binary"


def in_order(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The documents in the order of doc_id (null first) and text hash, in buckets of ranges of it: the rows of a bucket
    come to one task. Each bucket ends with copies, marked ``ahead``, of the document that follows its last one, which
    for the last bucket is the first document. A row of ``classes`` (kind 0) comes before its document's (kind 1).

    Bounds are over doc_id and text hash, so a doc_id that many rows have is split. The driver gets one bound a bucket,
    four buckets for a task. Texts are shuffled once, compressed.
    """
    least = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"), F.xxhash64("text").alias("th"))
    dealt = ids.repartitionByRange(4 * partitions(docs.sparkSession), "key", "th").groupBy(F.spark_partition_id().alias("p"))
    bounds = sorted(tuple(r["b"]) for r in dealt.agg(F.min(F.struct("key", "th")).alias("b")).collect())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, number = pa.Codec("zstd", compression_level=3), {b: i for i, b in enumerate(bounds)}
        for batch in batches:
            out = []
            for cell, (kind, doc_id, th, near) in zip(batch["text"], zip(*(batch[c].to_pylist() for c in ("kind", "doc_id", "th", "near_id")), strict=True), strict=True):
                key = least if doc_id is None else doc_id
                raw = (cell.as_py() or "").encode("utf-8", "surrogatepass")
                row = (key, th, kind, doc_id, near, len(raw), codec.compress(raw, asbytes=True) if raw else b"")
                out.append((bisect_right(bounds, (key, th)) - 1, False, *row))
                if kind and (b := number.get((key, th))) is not None:
                    out.append(((b - 1) % len(bounds), True, *row))
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names=[c.split()[0] for c in _ROW.split(", ")])

    rows = docs.select(F.lit(1).alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.lit(None).cast("long").alias("near_id"), "text")
    if classes is not None:
        rows = rows.unionByName(classes.select(F.lit(0).alias("kind"), "doc_id", "th", "near_id", F.lit(None).cast("string").alias("text")))
    return rows.mapInArrow(packed, _ROW).repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "ahead", "key", "th", "kind")


def fingerprints(docs: DataFrame, near: bool = False) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures`` of every
    document, and with ``near`` also ``near_id``.

    The edited text is the document with its last quarter replaced by the start of the next document, in the order of
    doc_id (null first) and text hash; rows of equal doc_ids stay rows of their own. A null text is empty. ``near_id``
    is the least doc_id of the document's near duplicates. An empty table has no rows.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", *(["near_id"] if near else [])]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())[: len(names)]

    def told(rows: list[tuple], after: str) -> pa.RecordBatch:
        texts = [r[0] for r in rows]
        marks = list(sets([*texts, after]))
        cuts = [len(t) // 4 for t in texts]
        edited = [t[: len(t) - n] + x[:n] for t, n, x in zip(texts, cuts, [*texts[1:], after], strict=True)]
        changed = list(sets(edited))
        out = []
        for k, (text, doc_id, least) in enumerate(rows):
            sha = hashlib.sha256(edited[k].encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(text), sha, fingerprint(marks[k]), fingerprint(changed[k]), _jaccard(marks[k], changed[k]), _jaccard(marks[k], marks[k + 1]), len(marks[k]), least)[: len(names)])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, size, own = pa.Codec("zstd"), [], 0, None
        for batch in batches:
            columns = zip(*(batch[c].to_pylist() for c in ("ahead", "kind", "doc_id", "near_id", "size")), strict=True)
            for cell, (ahead, kind, doc_id, least, length) in zip(batch["packed"], columns, strict=True):
                if not kind:
                    own = least
                    continue
                text = codec.decompress(cell.as_py(), length, asbytes=True).decode("utf-8", "surrogatepass") if length else ""
                if held and (ahead or size > LOT):
                    yield told(held, text)
                    held, size = [], 0
                if not ahead:
                    held.append((text, doc_id, own))
                    size += len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long" + (", near_id long" if near else "")
    return in_order(docs, near_classes(docs) if near else None).mapInArrow(compared, schema)
