"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table; appending a
shard moves only the rows that it takes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_arrow, shared, table


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of 64-bit keys, for a whole array at once."""
    key = keys.astype(np.uint64)
    at, to = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = to[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        to[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[to[live] < shards]
    return at


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, shard, grown_shard (with one more), slot (0, 1, ... in each shard) for
    every row of docs (doc_id, text).

    The shard is the jump hash of the 64-bit hash of doc_id. Rows are numbered in two steps: each task numbers its own
    rows of a shard, then the tasks' counts are summed up, so no shard meets in one task, however many rows share a key.
    Null text: no bytes; null doc_id: a key of its own; rows that share a doc_id share a shard and have slots of their
    own; extra columns are left out; an empty table gives an empty one."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("doc_id").alias("key")
    )

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            shard, grown = jump(key, shards), jump(key, shards + 1)
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=shards)
            local = np.empty(len(key), np.int64)
            local[order] = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
            seen += count
            yield pa.record_batch(
                [
                    b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(shard, pa.int32()), pa.array(grown, pa.int32()),
                    pa.array(np.full(len(key), part), pa.int32()), pa.array(local)
                ],
                ["doc_id", "size", "text_crc32", "shard", "grown_shard", "part", "local"]
            )

    rows = shared(slim.transform(by_arrow, run, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part int, local long"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return rows.join(base, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("base") + F.col("local")).alias("slot")
    )


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = assign(table(spark, sf_dir, "documents"), 24)
    return got.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
