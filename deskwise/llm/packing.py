"""Best-fit packing of token pieces under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from deskwise.llm.bpe import Encoder
from deskwise.llm.common import partitions


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, and the attention cost (the sum of squared lengths).

    ``rule``: ``norm`` takes the open sequence that leaves the smallest weighted norm of what remains,
    ``dot`` the one whose remaining capacities have the largest weighted dot product with the piece.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each piece, longest pieces first; equal scores go to the earlier bin."""
    limits = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    shortest = int(lengths.min()) if len(lengths) else 0
    left, names = np.empty((len(lengths), 3)), np.empty(len(lengths), np.int64)
    n_open = n_bins = 0
    for i in order:
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        best = -1
        if n_open:
            rest = left[:n_open] - need
            fits = np.flatnonzero((rest >= 0).all(axis=1))
            if len(fits):
                if capacity.rule == "dot":
                    score = -(left[fits] / limits * (need / limits) * weights).sum(axis=1)
                else:
                    score = ((rest[fits] / limits) ** 2 * weights).sum(axis=1)
                best = int(fits[np.argmin(score)])
        if best < 0:
            left[n_open], names[n_open] = limits, n_bins
            best, n_open, n_bins = n_open, n_open + 1, n_bins + 1
        bins[i], offsets[i] = names[best], capacity.tokens - int(left[best, 0])
        left[best] -= need
        if left[best, 0] < shortest or left[best, 1] < 1 or left[best, 2] < shortest**2:  # nothing more fits
            n_open -= 1
            left[best : n_open], names[best : n_open] = left[best + 1 : n_open + 1].copy(), names[best + 1 : n_open + 1].copy()
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 1024) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's tokens with ``end_id`` after them.

    Documents of more than ``length`` tokens are cut into full pieces, of which the first takes what is left over.
    A null or empty text has the end token alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encoder.ids(text.as_py()) + end
                n = len(ids) // 4
                first = n % length or length
                starts = [0, *range(first, n, length)]
                out += ((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: Capacity = Capacity(), together: int = 16_384) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length).

    Pieces are dealt evenly by all that they have, so that a doc_id of many rows is split too; each task packs ``together`` of its pieces at a time, in the order of
    doc_id and piece, so a repeated task gives the same sequences, and memory doesn't grow with the input. At most
    the last few sequences of each such lot are less full than one packing of everything would leave them.
    Pieces as long as a sequence fill one each. A piece that no empty sequence can hold is an error.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_bin = TaskContext.get().partitionId() << 40
        waiting: list[pa.RecordBatch] = []

        def lot() -> pa.Table:
            nonlocal next_bin
            rows = pa.Table.from_batches(waiting)
            lengths = rows["length"].to_numpy()
            if len(lengths) and (lengths.max() > capacity.tokens or lengths.max() ** 2 > capacity.attention):
                raise ValueError("a piece is longer than a sequence may be")
            bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            full = lengths == capacity.tokens
            bins[full] = np.arange(full.sum())
            some, at = best_fit(lengths[~full], capacity)
            bins[~full], offsets[~full] = some + full.sum(), at
            rows = rows.append_column("sequence_id", pa.array(bins + next_bin)).append_column("offset", pa.array(offsets))
            next_bin += int(bins.max(initial=-1)) + 1
            waiting.clear()
            return rows

        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                part = batch.slice(at, together)
                if n + part.num_rows > together and waiting:
                    yield from lot().to_batches()
                    n = 0
                waiting.append(part)
                n += part.num_rows
        if waiting:
            yield from lot().to_batches()

    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    plain = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32") if c in items.columns]
    return items.repartition(partitions(items.sparkSession), *plain).sortWithinPartitions(*plain).mapInArrow(packed, schema)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document."""
    return pack(pieces(docs, tokenizer, end_id, capacity.tokens), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
