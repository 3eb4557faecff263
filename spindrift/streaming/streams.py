"""Structured Streaming forms of the log operators: event-time windows with a watermark, sessions, routing, dead letters,
stateful rate limits and incremental indexing. A stream's result is a table of files, written once for each batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import store

WATERMARK = "1 hour"


def work_dir(spark: SparkSession) -> str:
    """A new folder in the folder that the cluster shares."""
    return store.new_dir(spark, "stream")


def files(spark: SparkSession, folder: str, name: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """A stream of one table, which is a Parquet file or a folder of such."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(f"{folder}/{name}.parque[t]")  # a pattern, so that the path may be a file


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


#: The event that ends a stream which is drained: later than any other, it closes every window.
END = -1


def events(spark: SparkSession, folder: str, ends: bool = False) -> DataFrame:
    """The event table as a stream; ts is cast to TIMESTAMP, which watermarks need. With ends, an event of its own (END) follows
    in the far future, so that a stream in append mode, drained with last=True, gives its last windows as well."""
    raw = files(spark, folder, "events", EVENTS)
    if ends:
        at = work_dir(spark)
        spark.createDataFrame([(END,)], "event_id long").selectExpr(
            "event_id", "TIMESTAMP_NTZ '9000-01-01' AS ts", f"CAST({END} AS BIGINT) AS user_id", "'end' AS event_type", "0D AS value", "'{}' AS props"
        ).write.parquet(f"{at}/end.parquet")
        raw = raw.unionByName(files(spark, at, "end", EVENTS))
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), "event_type", "value",
        F.concat(F.lit("events."), "event_type").alias("topic")
    ).withWatermark("ts", WATERMARK)


def kafka(spark: SparkSession, servers: str, topics: str, schema: str) -> DataFrame:
    """Events of a message bus: JSON values, malformed ones as nulls in `event`. Needs the Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).load()
    return raw.select(
        F.col("topic"), F.col("key").cast("string").alias("event_id"),
        F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"}).alias("event"), "timestamp"
    )


def to_kafka(rows: DataFrame, servers: str, topic: str, checkpoint: str):
    """rows (event_id, any) as JSON messages keyed by event_id."""
    out = rows.select(F.col("event_id").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its table. Each batch writes a folder of its own, so a batch that is run
    again after a failure replaces its own rows; nothing that is written is written again. In update mode, which gives
    the rows that a batch has changed, the table has the last row of each of the keys."""
    spark, at = stream.sparkSession, work_dir(stream.sparkSession)

    def put(batch: DataFrame, n: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if query.lastProgress is None or not any(p["numInputRows"] for p in query.recentProgress):
        return put_nothing(each(spark.createDataFrame([], stream.schema)) if each else spark.createDataFrame([], stream.schema))
    read = spark.read.parquet(f"{at}/out")
    if mode == "update":
        rest = [c for c in read.columns if c not in (*keys, "batch")]
        last = read.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
        return last.select(*[c if c in keys else F.col("_last").getField(c).alias(c) for c in read.columns if c != "batch"])
    return read.drop("batch")


def put_nothing(empty: DataFrame) -> DataFrame:
    """The result of a stream that had no rows."""
    return empty.where("false")


def volume(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """window start, event_type, events, total value; a window's state goes when the watermark has passed it."""
    got = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def topic_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("topic").agg(F.count("*").alias("events"), F.max("ts").alias("last"))


def sessions(stream: DataFrame, gap: str = "1 hour") -> DataFrame:
    """session_id, start, end, events, once a session is over; its state goes then."""
    got = stream.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return got.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def dead_letters(stream: DataFrame, failed, retries, most: int = 3) -> DataFrame:
    """event_id, topic, status, retry_count: what failed is tried again until `most`, then dead-lettered."""
    rows = stream.select("event_id", "topic", failed.alias("f"), retries.alias("retry_count"))
    status = F.when(~F.col("f"), "delivered").when(F.col("retry_count") < most, "failed").otherwise("dead_lettered")
    return rows.select("event_id", "topic", status.alias("status"), "retry_count")


def replay(letters: DataFrame) -> DataFrame:
    """Dead letters as new events, with no retries yet."""
    return letters.where("status = 'dead_lettered'").select("event_id", "topic", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))


def rate_limit(stream: DataFrame, limit: int, seconds: float) -> DataFrame:
    """event_id, session_id, accepted under a sliding window of accepted requests. The state of a client is the times in
    its window, `limit` at most, and is dropped when the watermark has passed it."""

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        # Of a client's requests in a batch, times and ids are held, as numbers, to be put in order.
        ids, times = zip(*((b["event_id"].to_numpy(), b["t"].to_numpy()) for b in batches))
        ids, times = np.concatenate(ids), np.concatenate(times)
        order = np.lexsort((ids, times))
        ids, times = ids[order], times[order]
        held, out = deque(state.get[0] if state.exists else ()), np.empty(len(times), bool)
        for i, t in enumerate(times.tolist()):
            while held and held[0] <= t - seconds:
                held.popleft()
            out[i] = len(held) < limit
            if out[i]:
                held.append(t)
        state.update((list(held),))
        end = int((times[-1] + seconds) * 1000)
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        for i in range(0, len(ids), 10_000):
            yield pd.DataFrame({"event_id": ids[i : i + 10_000], "session_id": key[0], "accepted": out[i : i + 10_000]})

    rows = stream.select("event_id", "session_id", "ts", F.col("ts").cast("double").alias("t"))
    return rows.groupBy("session_id").applyInPandasWithState(
        run, "event_id long, session_id long, accepted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def unique(stream: DataFrame) -> DataFrame:
    """Each event once, as far as the watermark remembers."""
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def index_documents(spark: SparkSession, folder: str, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch form of an indexing step (postings, chunks, vectors) over a stream of documents."""
    stream = files(spark, folder, "documents", "doc_id long, text string, lang string, source string, n_chars long")
    return drain(stream, "append", each)
