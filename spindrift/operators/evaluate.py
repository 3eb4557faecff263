"""Retrieval evaluation of results (system, query_id, doc_id, rank) against judgements (query_id, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def _judged(results: DataFrame, judged: DataFrame) -> DataFrame:
    """Every judged query for every system, with the relevant results' ranks; a query without results keeps a row."""
    per = judged.where("grade > 0").groupBy("query_id").agg(F.count("*").alias("relevant"))
    systems = results.select("system").distinct()
    hit = results.join(judged.where("grade > 0"), ["query_id", "doc_id"]).select("system", "query_id", "rank", "grade")
    return systems.crossJoin(per).join(hit, ["system", "query_id"], "left")


def per_query(results: DataFrame, judged: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """system, query_id and the metrics, unrounded. Precision divides by k, whatever was returned; gain is linear."""
    rows = _judged(results, judged)
    so_far = Window.partitionBy("system", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.count("rank").over(so_far))
    hits = lambda k: F.count(F.when(F.col("rank") <= k, 1))
    gain = lambda g, r: g / F.log2(r + F.lit(1.0))
    aggs = [
        F.first("relevant").alias("relevant"), F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("mrr"),
        (F.coalesce(F.sum(F.col("n") / F.col("rank")), F.lit(0.0)) / F.first("relevant")).alias("map")
    ]
    aggs += [(hits(k) / F.lit(k)).alias(f"precision_{k}") for k in ks] + [(hits(k) / F.first("relevant")).alias(f"recall_{k}") for k in ks]
    aggs += [F.coalesce(F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))), F.lit(0.0)).alias(f"dcg_{k}") for k in ks]
    got = rows.groupBy("system", "query_id").agg(*aggs)
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ideal = judged.where("grade > 0").withColumn("i", F.row_number().over(best))
    ideal = ideal.groupBy("query_id").agg(*[F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i")))).alias(f"ideal_{k}") for k in ks])
    both = got.join(ideal, "query_id")
    return both.select(
        "system", "query_id", "mrr", "map",
        *[c for k in ks for c in (
            f"precision_{k}", f"recall_{k}",
            F.when(F.col(f"ideal_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).otherwise(0.0).alias(f"ndcg_{k}")
        )]
    )


def metrics(ks: tuple[int, ...] = KS) -> list[str]:
    return ["mrr", "map", *[f"{m}_{k}" for k in ks for m in ("precision", "recall", "ndcg")]]


def aggregate(results: DataFrame, judged: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """system and the mean of each metric over the judged queries, to 4 places."""
    return per_query(results, judged, ks).groupBy("system").agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics(ks)])


def table(results: DataFrame, judged: DataFrame, ks: tuple[int, ...] = KS, systems: list[str] | None = None) -> DataFrame:
    """metric x system."""
    long = aggregate(results, judged, ks).select(
        "system", F.explode(F.create_map(*[x for m in metrics(ks) for x in (F.lit(m), F.col(m))])).alias("metric", "value")
    )
    return long.groupBy("metric").pivot("system", systems).agg(F.first("value"))


def save(run: str, results: DataFrame, judged: DataFrame, path: str) -> None:
    """Adds the means of a run's systems to an experiment log: run, system, metric, value."""
    long = aggregate(results, judged).select(
        F.lit(run).alias("run"), "system", F.explode(F.create_map(*[x for m in metrics() for x in (F.lit(m), F.col(m))])).alias("metric", "value")
    )
    long.write.mode("append").parquet(path)


def compare(log: DataFrame, first: str, second: str) -> DataFrame:
    """system, metric, before, after, difference of two runs of a log."""
    a, b = (log.where(F.col("run") == r).select("system", "metric", F.col("value").alias(n)) for r, n in ((first, "before"), (second, "after")))
    return a.join(b, ["system", "metric"], "full_outer").select(
        "system", "metric", "before", "after", F.round(F.col("after") - F.col("before"), 4).alias("difference")
    )
