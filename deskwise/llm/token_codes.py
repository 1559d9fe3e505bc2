"""Token ids in directly addressable codes: any token is read without decoding the others.

A block holds the ids of whole documents. Ids are split into chunks of ``BITS`` bits. Level 0 has the low chunk
of every token and a bitmap of the tokens that go on; level k+1 has the next chunk of those that go on in level k.
The rank directory counts the set bits before every ``STEP`` bits, so that a token's place in the next level is one
look-up and a count within ``STEP`` bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskwise.llm.bpe import Encoder
from deskwise.llm.common import partitions

BITS, STEP = 8, 512
#: Pieces of text whose ids a Python worker keeps, some 60 MB.
PIECES = 400_000
_LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
_DOC = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.list_(_DOC)), ("levels", pa.list_(_LEVEL))])
BLOCK_TYPE = "shard int, block int, shard_start long, n_tokens long, docs array<struct<doc_id: long, start: long, n_tokens: long>>, levels array<struct<chunks: binary, more: binary, ranks: binary>>"


def encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> BITS > 0
        before = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), STEP), dtype=np.int64))[:-1]]) if len(more) else np.zeros(0)
        levels.append({"chunks": (rest & (1 << BITS) - 1).astype(np.uint8).tobytes(), "more": np.packbits(more, bitorder="little").tobytes(), "ranks": before.astype("<u4").tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> BITS


def decode(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a block."""
    ids = np.zeros(0, np.uint32)
    for level in reversed(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["more"], np.uint8), count=len(chunks), bitorder="little").astype(bool)
        chunks[more] |= ids << BITS
        ids = chunks
    return ids


def token(levels: list[dict[str, bytes]], at: int) -> int:
    """The id at a place of a block, by rank alone."""
    value = 0
    for k, level in enumerate(levels):
        value |= level["chunks"][at] << BITS * k
        if not level["more"][at >> 3] >> (at & 7) & 1:
            break
        first = at // STEP * STEP
        bits = int.from_bytes(level["more"][first >> 3 : (at >> 3) + 1], "little") & (1 << at - first) - 1
        at = int.from_bytes(level["ranks"][4 * (at // STEP) : 4 * (at // STEP) + 4], "little") + bits.bit_count()
    return value


def write_codes(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, block: int = 1 << 15) -> None:
    """Writes the ids of every text, each document's followed by ``end_id``, in ascending doc_id order.

    A block takes documents until it has ``block`` tokens. Null or empty texts have the end token alone; null doc_ids
    come first; the order of equal doc_ids, which are dealt to several tasks if they are many, is that of a hash of
    their texts. An empty table gives files without blocks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end, shard = Encoder.of(tokenizer, PIECES), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        held: list[bytes] = []
        found: list[dict] = []
        n = before = number = 0

        def full() -> pa.RecordBatch:
            row = {"shard": shard, "block": number, "shard_start": before, "n_tokens": n, "docs": found, "levels": encode(np.frombuffer(b"".join(held), "<u4"))}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encoder.ids(text.as_py()) + end
                held.append(ids)
                found.append({"doc_id": doc_id, "start": n, "n_tokens": len(ids) // 4})
                n += len(ids) // 4
                if n >= block:
                    yield full()
                    before, number, n, held, found = before + n, number + 1, 0, [], []
        if found:
            yield full()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCK_TYPE).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``before``, the number of tokens in all earlier shards.

    Only the totals of shards, one row for each task that wrote, come together in one task.
    """
    found = spark.read.schema(BLOCK_TYPE).parquet(path)
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return found.join(F.broadcast(before), "shard")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document from the files."""
    kinds = (pa.int64(),) * 4

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, first = decode(row["levels"]).astype("<u4"), row["before"] + row["shard_start"]
                out = [(d["doc_id"], first + d["start"], d["n_tokens"], zlib.crc32(ids[d["start"] : d["start"] + d["n_tokens"]].tobytes())) for d in row["docs"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_blocks(spark, path).select("shard_start", "before", "docs", "levels").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(wanted: DataFrame, path: str, lot: int = 4096) -> DataFrame:
    """``doc_id, position, token_id`` for each wanted (doc_id, position); null where there is no such token.

    Requests are gathered by block, at most about ``lot`` of a block in a row, and a block's codes are read once for such
    a row, of which only the wanted tokens are decoded. Requests for a doc_id that several documents have are answered
    from each of them; a null doc_id has no token.
    """
    spark = wanted.sparkSession
    blocks = spark.read.schema(BLOCK_TYPE).parquet(path)
    places = blocks.select("shard", "block", F.explode("docs").alias("d")).select("shard", "block", "d.*")
    asked = wanted.select("doc_id", F.col("position").cast("long").alias("position")).join(places, "doc_id", "left")
    there = (F.col("position") >= 0) & (F.col("position") < F.col("n_tokens"))
    none = asked.where(~F.coalesce(there, F.lit(False))).select("doc_id", "position", F.lit(None).cast("long").alias("token_id"))
    asked = asked.where(there).select("shard", "block", "doc_id", "position", (F.col("start") + F.col("position")).alias("at"))
    sizes = asked.groupBy("shard", "block").agg(F.ceil(F.count("*") / lot).cast("int").alias("lots"))
    dealt = asked.join(sizes, ["shard", "block"]).withColumn("lot", F.pmod(F.xxhash64("at"), F.col("lots")))
    requests = dealt.groupBy("shard", "block", "lot").agg(F.collect_list(F.struct("doc_id", "position", "at")).alias("asked"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = [token(row["levels"], x["at"]) for x in row["asked"]]
                arrays = [[x["doc_id"] for x in row["asked"]], [x["position"] for x in row["asked"]], found]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["doc_id", "position", "token_id"])

    read = requests.join(blocks.select("shard", "block", "levels"), ["shard", "block"]).select("asked", "levels")
    return read.mapInArrow(ids, "doc_id long, position long, token_id long").unionByName(none)
