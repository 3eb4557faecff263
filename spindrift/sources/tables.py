"""The reference's entities on the supplied tables (see README): corpus, search logs, cost events, judgements, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The point in time that ages count from.
AS_OF = "2025-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores. A small file of one row group is one partition, on which all the
    work on its texts would wait; a table of many files or row groups is left as it is, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (first line), body, source, created_at."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    created = F.timestamp_add("DAY", F.pmod("doc_id", F.lit(365)).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return docs.select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "source", created.alias("created_at")
    )


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, session_id, event_type, value, query, position; ts is a TIMESTAMP, as watermarks need."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), "event_type", "value",
        F.concat(F.lit("q"), k.cast("string")).alias("query"), F.pmod(k, F.lit(10)).alias("position")
    )


def searches(events: DataFrame) -> DataFrame:
    """Views are searches with results, errors such without."""
    return events.where(F.col("event_type").isin("view", "error")).select(
        "event_id", "ts", "session_id", "query", (F.col("event_type") == "view").cast("int").alias("results_count"),
        F.col("value").alias("latency_ms")
    )


def clicks(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "click").select("event_id", "ts", "session_id", "query", "position")


def cost_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"),
        F.concat(F.lit("t"), F.pmod("user_id", F.lit(5)).cast("string")).alias("tenant_id"),
        F.concat(F.lit("p"), F.pmod("user_id", F.lit(3)).cast("string")).alias("provider"), (F.col("value") / 1000).alias("cost_usd")
    )


def terms_of(queries: DataFrame) -> DataFrame:
    """query_id, place, term: what the index would hold of queries (query_id, query)."""
    return queries.select("query_id", F.posexplode(T.terms(F.col("query"))).alias("place", "term"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the benchmark texts are the queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, place, term: all terms of each benchmark text."""
    return terms_of(asked(spark, sf_dir))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, grade of the relevant documents."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", (F.lit(2.0) - F.col("toxic")).alias("grade"))


# -- files


def text_directory(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """title (file stem), content, source of all *.txt files that aren't blank and whose source isn't known."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(
        "value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("name")
    )
    new = files.where(F.trim("value") != "").select(F.regexp_replace("name", r"\.txt$", "").alias("title"), F.col("value").alias("content"), "source")
    return new if known is None else new.join(known.select("source"), "source", "left_anti")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, doc_id, grade from a JSON array; documents without a grade have 1."""
    read = spark.read.schema(
        "query_id string, query string, relevant_doc_ids array<long>, relevance_scores map<string,double>"
    ).json(path, multiLine=True)
    return read.select("query_id", "query", F.explode("relevant_doc_ids").alias("doc_id"), "relevance_scores").select(
        "query_id", "query", "doc_id", F.coalesce(F.col("relevance_scores")[F.col("doc_id").cast("string")], F.lit(1.0)).alias("grade")
    )


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """term, synonyms from a JSON map, in lower case."""
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return read.select(F.explode("m").alias("term", "s")).select(F.lower("term").alias("term"), F.transform("s", F.lower).alias("synonyms"))


def cost_log(costs: DataFrame, path: str) -> None:
    """Cost events as JSON lines, added to what is there."""
    costs.write.mode("append").json(path)


def read_cost_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("event_id long, ts timestamp, category string, tenant_id string, provider string, cost_usd double").json(path)


def cost_csv(costs: DataFrame, path: str) -> None:
    costs.select("timestamp", "category", "provider", "model", "cost_usd", "tenant_id").orderBy("timestamp").write.csv(path, header=True)
