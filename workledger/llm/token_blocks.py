"""Token-id output: documents as range-coded blocks of ids, in ascending doc_id order.

The file format is a Parquet table, one row per *segment* of whole consecutive documents:

==========  ===============================================================================
shard       number of the range of doc_ids; shards ascend
segment     number of the segment in its shard
doc_ids     the documents of the segment, ascending
n_ids       how many ids each document has, its end id included
table       ids that occur and their shares, which the coder's order 0 starts from (``IdTable``)
data        blocks of up to ``block_ids`` ids, joined; each is reset, coded and checksummed
            by itself (see ``rangecoder``), so any block decodes alone
==========  ===============================================================================

Spark's writer commits it, so a lost executor leaves no half file, and any file system will do. A segment has
at least ``segment_ids`` ids unless it ends its shard; a longer document is a segment of its own size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from workledger.llm.common import python_batches, text_bytes, written
from workledger.llm.rangecoder import IdTable, decode_blocks, encode_blocks, split_blocks
from workledger.llm.tokens import piece_ids


@dataclass(frozen=True)
class BlockConfig:
    """``lanes`` blocks are coded side by side; memory is in proportion to ``lanes * block_ids``.

    Texts of about ``text_bytes`` together, or one that is longer, are cut into ids at once.
    """

    end_id: int = 2
    block_ids: int = 2_048
    segment_ids: int = 524_288
    lanes: int = 4_096
    text_bytes: int = 4_194_304


SCHEMA = "segment long, doc_ids array<long>, n_ids array<long>, table binary, data binary"


def _parts(keys: list, bodies: list[bytes], most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in order, in parts whose bodies have ``most`` bytes together, or are a single longer one."""
    first = size = 0
    for i, body in enumerate(bodies):
        if size and size + len(body) > most:
            yield keys[first:i], bodies[first:i]
            first, size = i, 0
        size += len(body)
    if bodies:
        yield keys[first:], bodies[first:]


def _encode(path: str, config: BlockConfig):
    end = np.array([config.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = piece_ids(path)
        pending: list[tuple[list, list, bytes]] = []
        blocks = number = 0
        docs: list = []
        lengths: list[int] = []
        held: list[bytes] = []
        size = 0

        def close() -> None:
            nonlocal size, blocks
            pending.append((docs.copy(), lengths.copy(), b"".join(held)))
            blocks += -(-size // config.block_ids)
            docs.clear()
            lengths.clear()
            held.clear()
            size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, blocks
            # segments coded together share one table; each row has it, so that it decodes alone
            table = IdTable.of(np.frombuffer(b"".join(data for _, _, data in pending), "<u4"))
            cut: list[np.ndarray] = []
            counts = []
            for _, _, data in pending:
                ids = np.frombuffer(data, "<u4")
                parts = [ids[i : i + config.block_ids] for i in range(0, len(ids), config.block_ids)]
                counts.append(len(parts))
                cut += parts
            coded: list[bytes] = []
            for i in range(0, len(cut), config.lanes):
                coded += encode_blocks(cut[i : i + config.lanes], table)
            at = np.concatenate([[0], np.cumsum(counts)]).tolist()
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(range(number, number + len(pending)), pa.int64()),
                    pa.array([d for d, _, _ in pending], pa.list_(pa.int64())),
                    pa.array([n for _, n, _ in pending], pa.list_(pa.int64())),
                    pa.array([table.to_bytes()] * len(pending), pa.binary()),
                    pa.array([b"".join(coded[a:b]) for a, b in zip(at, at[1:])], pa.binary()),
                ],
                names=["segment", "doc_ids", "n_ids", "table", "data"],
            )
            number += len(pending)
            pending.clear()
            blocks = 0
            return batch

        for batch in batches:
            for keys, bodies in _parts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), config.text_bytes):
                for key, ids in zip(keys, ids_of(bodies), strict=True):
                    docs.append(key)
                    held.append(ids + end)
                    lengths.append(len(ids) // 4 + 1)
                    size += lengths[-1]
                    if size >= config.segment_ids:
                        close()
                        if blocks >= config.lanes:
                            yield flush()
        if docs:
            close()
        if pending:
            yield flush()

    return run


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, config: BlockConfig = BlockConfig(), order: tuple[str, ...] = ()) -> None:
    """``(doc_id, text)`` -> token files under ``path``, in the order of the columns ``order``, else of doc_id.

    A null or empty text is its end id alone. Rows without doc_id come first; rows that repeat a doc_id stand
    together in the order of their texts. No rows give files without segments. Other columns are not read.
    """
    python_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"order_{i}") for i, c in enumerate(order)))
    keys = [f"order_{i}" for i in range(len(order))] or ["doc_id"]
    # texts become bytes after the exchange: the range partition's sample reads what is in front of it once more
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "doc_id", "text").select("doc_id", text_bytes().alias("body"))
    coded = sorted_.mapInArrow(_encode(tokenizer_path, config), SCHEMA)
    coded.withColumn("shard", F.spark_partition_id().cast("long")).write.parquet(path)


def token_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", shard long").parquet(path)


def decode_segment_ids(data: list[bytes], table: bytes, config: BlockConfig) -> list[np.ndarray]:
    """Ids of several segments with one table, their blocks decoded side by side."""
    parts = [split_blocks(d) for d in data]
    flat = [b for p in parts for b in p]
    order0 = IdTable.from_bytes(table)
    ids: list[np.ndarray] = []
    for i in range(0, len(flat), config.lanes):
        ids += decode_blocks(flat[i : i + config.lanes], order0)
    out, at = [], 0
    for p in parts:
        out.append(np.concatenate(ids[at : at + len(p)]) if p else np.empty(0, np.uint32))
        at += len(p)
    return out


def _check(config: BlockConfig):
    per_call = max(1, config.lanes * config.block_ids // config.segment_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[dict]) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], [], []]
            for row, ids in zip(held, decode_segment_ids([r["data"] for r in held], held[0]["table"], config), strict=True):
                ends = np.cumsum(row["n_ids"])
                if len(ids) != ends[-1]:
                    raise ValueError(f"segment {row['shard']}/{row['segment']} has {len(ids)} ids, not {ends[-1]}")
                little = ids.astype("<u4", copy=False)
                for i, (doc, n, stop) in enumerate(zip(row["doc_ids"], row["n_ids"], ends.tolist(), strict=True)):
                    crc = zlib.crc32(little[stop - n : stop])
                    for column, value in zip(columns, (row["shard"], row["segment"], i, doc, stop - n, crc), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["shard", "segment", "at", "doc_id", "inner", "ids_crc32"]
            )

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) >= per_call or row["table"] != held[0]["table"]):
                    yield rows(held)
                    held = []
                held.append(row)
        if held:
            yield rows(held)

    return run


def read_documents(spark: SparkSession, path: str, config: BlockConfig = BlockConfig()) -> DataFrame:
    """Files under ``path`` -> ``doc_id, start, n_tokens, ids_crc32`` of every document, all blocks decoded.

    Only totals of segments are summed across a shard and totals of shards across the table.
    """
    segments = token_segments(spark, path)
    decoded = segments.select("shard", "segment", "doc_ids", "n_ids", "table", "data").mapInArrow(
        _check(config), "shard long, segment long, at long, doc_id long, inner long, ids_crc32 long"
    )
    totals = written(
        segments.select("shard", "segment", F.expr("aggregate(n_ids, 0L, (a, n) -> a + n)").alias("ids"), "n_ids"), "totals"
    )
    shards = totals.groupBy("shard").agg(F.sum("ids").alias("ids"))
    shards = shards.select(
        "shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shard_start")
    )
    order = Window.partitionBy("shard").orderBy("segment")
    starts = (
        totals.withColumn("in_shard", F.sum("ids").over(order) - F.col("ids"))
        .join(F.broadcast(shards), "shard")
        .select("shard", "segment", (F.col("shard_start") + F.col("in_shard")).alias("before"), "n_ids")
    )
    return decoded.join(starts, ["shard", "segment"]).select(
        "doc_id",
        (F.col("before") + F.col("inner")).alias("start"),
        F.expr("n_ids[cast(at as int)]").alias("n_tokens"),
        "ids_crc32",
    )
