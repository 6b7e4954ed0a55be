"""Token-ID output: documents as one ascending run of ids in patched frame-of-reference files.

``write`` deals the documents by range of ``doc_id`` into shards (one shuffle of the texts), encodes
each shard in order and writes file images of some ``SEGMENT`` ids, whole documents each, with the
documents' lengths; they are the rows of a Parquet table, so that any store Spark writes to will do.
``read`` decodes them. Only counts per segment meet in one place to number the ids.

Shards grow in number with the table's size. Null texts are empty and still get the end id; null doc_ids come first; rows of equal doc_id are
ordered by their text's hash, then text. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pfor
from .common import Scratch, table, text_of
from .tokenize import default_path, encoder

SEGMENT = 1 << 18
#: Bytes of the input's files to a shard.
SHARD = 64 << 20
#: Chunks whose ids a worker keeps: more than in packing, as no other stage's memory counts beside it.
CHUNKS = 700_000
SEGMENTS = "shard int, segment int, n_ids long, doc_ids array<long>, lengths binary, image binary"
PIECES = "shard int, segment int, doc_id long, before long, n_tokens long, ids binary"


def encode_shards(docs: DataFrame, path: str, end_id: int, shards: int, percentile: float = 0.9) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, CHUNKS), np.array([end_id], "<u4").tobytes()
        shard, number = None, 0
        keys: list = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            lengths = np.array([len(p) // 4 for p in parts], "<u4")
            row = {"shard": shard, "segment": number, "n_ids": len(ids), "doc_ids": list(keys), "lengths": lengths.tobytes(), "image": pfor.encode(ids, percentile)}
            keys.clear()
            parts.clear()
            number, held = number + 1, 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("image", pa.binary())])
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                for s, key, ids in zip(part["shard"].to_pylist(), part["doc_id"].to_pylist(), enc.encode(part["text"].to_pylist()), strict=True):
                    if s != shard:
                        if parts:
                            yield flush()
                        shard, number = s, 0
                    keys.append(key)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= SEGMENT:
                        yield flush()
        if parts:
            yield flush()

    text = text_of(docs)
    dealt = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    return dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(run, SEGMENTS)


def decode_segments(segments: DataFrame) -> DataFrame:
    """A row per document of each segment: the ids before it there, its length and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for i in range(len(batch)):
                row = {k: batch[k][i] for k in ("shard", "segment", "doc_ids", "lengths", "image")}
                lengths = np.frombuffer(row["lengths"].as_py(), "<u4").astype(np.int64)
                raw, ends = pfor.decode(row["image"].as_py()).astype("<u4").tobytes(), np.cumsum(lengths)
                starts = ends - lengths
                ids = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"].as_py()] * n, pa.int32()), pa.array([row["segment"].as_py()] * n, pa.int32()), row["doc_ids"].values, pa.array(starts), pa.array(lengths), pa.array(ids, pa.binary())], schema=schema)

    return segments.mapInArrow(run, PIECES)


def write(docs: DataFrame, scratch: Scratch, path: str | None = None, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """The written segments, reread."""
    if not shards:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # a Scala or a plain integer
        shards = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    return scratch.save(encode_shards(docs, path or default_path(), end_id, shards), "token-segments")


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document, from the files."""
    each = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each shard and, below, for each segment of a shard
    shards = each.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment")
    base = segments.select("shard", "segment", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("segment_start")).join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("base"))
    pieces = decode_segments(segments.select("shard", "segment", "n_ids", "doc_ids", "lengths", "image"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").join(base, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    return read(write(table(spark, sf_dir, "documents"), scratch))
