"""Fusion of ranked lists (list_id, doc_id, score, rank), each query apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import top_k

_LIST = ("query_id", "list_id")


def minmax(score: str = "score", *by: str) -> Column:
    """score between 0 and 1 within its list; 0 if all are equal."""
    w = Window.partitionBy(*(by or _LIST))
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    return (F.col(score) - low) / F.when(span == 0, 1.0).otherwise(span)


def _ordered(scored: DataFrame, k: int | None) -> DataFrame:
    out = scored.select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return top_k(out, k if k is not None else 2**31 - 1, "query_id")


def rrf(lists: DataFrame, k: int | None = None, c: int = 60) -> DataFrame:
    return _ordered(lists.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("score")), k)


def combsum(lists: DataFrame, k: int | None = None) -> DataFrame:
    return _ordered(lists.withColumn("n", minmax()).groupBy("query_id", "doc_id").agg(F.sum("n").alias("score")), k)


def combmnz(lists: DataFrame, k: int | None = None) -> DataFrame:
    return _ordered(lists.withColumn("n", minmax()).groupBy("query_id", "doc_id").agg((F.sum("n") * F.count("*")).alias("score")), k)


def weighted(lists: DataFrame, k: int | None = None, weights: dict[int, float] | None = None) -> DataFrame:
    """Weights by list_id are scaled to a sum of 1; without any, each list of a query weighs the same."""
    if weights:
        total = sum(weights.values()) or 1.0
        weight = F.coalesce(F.create_map(*[F.lit(x) for i, w in weights.items() for x in (i, w / total)])[F.col("list_id")], F.lit(0.0))
        rows = lists.withColumn("w", weight)
    else:
        rows = lists.withColumn("w", F.lit(1.0) / F.size(F.collect_set("list_id").over(Window.partitionBy("query_id"))))
    return _ordered(rows.withColumn("n", minmax() * F.col("w")).groupBy("query_id", "doc_id").agg(F.sum("n").alias("score")), k)


def linear(lists: DataFrame, k: int | None = None, first: float = 0.5) -> DataFrame:
    return weighted(lists, k, {1: first, 2: 1.0 - first})


def borda(lists: DataFrame, k: int | None = None) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*_LIST))
    return _ordered(lists.withColumn("p", (n - F.col("rank")).cast("double")).groupBy("query_id", "doc_id").agg(F.sum("p").alias("score")), k)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "rrf": rrf, "combsum": combsum, "combmnz": combmnz, "weighted": weighted, "borda": borda, "linear": linear
}


def compare(lists: DataFrame, k: int = 10) -> DataFrame:
    """strategy, query_id, doc_id, score, rank of every strategy."""
    out = None
    for name in ("rrf", "combsum", "combmnz", "weighted", "borda"):
        got = STRATEGIES[name](lists, k).withColumn("strategy", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int = 10, strategy: str = "rrf", pool: int | None = None) -> DataFrame:
    """query_id, doc_id, score, rank, lexical_rank, semantic_rank: the first 2k (or `pool`) of both lists fused."""
    n = pool or 2 * k
    cut = [
        x.where(F.col("rank") <= n).select("query_id", "doc_id", "score", "rank", F.lit(i).alias("list_id")) for i, x in ((1, lexical), (2, semantic))
    ]
    fused = STRATEGIES[strategy](cut[0].unionByName(cut[1]), k)
    for x, name in zip(cut, ("lexical_rank", "semantic_rank")):
        fused = fused.join(x.select("query_id", "doc_id", F.col("rank").alias(name)), ["query_id", "doc_id"], "left")
    return fused
