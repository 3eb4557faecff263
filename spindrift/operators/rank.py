"""Ranking: BM25, TF-IDF and the tuned sum of signals, for many queries in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from .index import Index

K1, B = 1.5, 0.75
#: BM25, title, recency, clicks.
WEIGHTS = (1.0, 1.8, 0.05, 0.3)


def top_k(scored: DataFrame, k: int, *by: str, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows for each value of `by` with their rank; ties by id. Catalyst cuts each partition to k rows before
    the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def tf_part(tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / avgdl))


def bm25_parts(ix: Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, term, field, df, tf, idf, tf_weight, score for every distinct query term (query_id, term) in a field
    of a document. Only the body counts: a title has score 0, so documents with a term in the title alone are found."""
    asked = ix.term_df(queries).select("query_id", "term", "df").withColumn("idf", idf(F.lit(float(ix.n)), F.col("df").cast("double")))
    found = ix.of_terms(ix.postings.drop("positions"), asked)
    length = F.when(F.col("word_count") > 0, F.col("word_count")).otherwise(1)
    part = tf_part(F.col("tf").cast("double"), length.cast("double"), F.lit(ix.avgdl), k1, b)
    out = found.withColumn("tf_weight", F.when(F.col("field") == "body", part).otherwise(0.0))
    return out.withColumn("score", F.col("idf") * F.col("tf_weight")).drop("word_count", "body_df")


def bm25_terms(ix: Index, queries: DataFrame, **how) -> DataFrame:
    """query_id, doc_id, term, df, tf, idf, tf_weight, score: the parts of a score, one row for each term of a document."""
    body = F.col("field") == "body"
    rows = bm25_parts(ix, queries, **how).groupBy("query_id", "doc_id", "term", "df", "idf")
    return rows.agg(F.sum(F.when(body, F.col("tf")).otherwise(0)).alias("tf"), F.sum("tf_weight").alias("tf_weight"), F.sum("score").alias("score"))


def bm25(ix: Index, queries: DataFrame, k: int = 10, **how) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query (query_id, term)."""
    scored = bm25_parts(ix, queries, **how).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return top_k(scored, k, "query_id")


def widened(ix: Index, queries: DataFrame, expanded: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank: documents with a term of the query or of expanded (query_id, term), its synonyms, ranked
    by the query's own terms; what only a synonym finds has score 0."""
    both = queries.select("query_id", "term").unionByName(expanded.select("query_id", "term")).distinct()
    found = ix.of_terms(
        ix.postings.select(*[c for c in ix.postings.columns if c in ("bucket", "term", "doc_id")]), both
    ).select("query_id", "doc_id").distinct()
    scored = bm25_parts(ix, queries).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    rows = found.join(scored, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    return top_k(rows, k, "query_id")


def tfidf(ix: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank by cosine of the TF-IDF vectors (body terms; query tf is count over length). The norms
    of the documents are the index's."""
    size = queries.groupBy("query_id").agg(F.count("*").alias("len"))
    weigh = ix.term_df(queries).where("body_df > 0").select("query_id", "term", F.log(F.lit(float(ix.n)) / F.col("body_df")).alias("idf"))
    asked = queries.groupBy("query_id", "term").agg(F.count("*").alias("c")).join(size, "query_id").join(weigh, ["query_id", "term"])
    asked = store.kept(asked.select("query_id", "term", "idf", (F.col("c") / F.col("len") * F.col("idf")).alias("q")))
    asked_norm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    found = ix.of_terms(ix.postings.where("field = 'body'").drop("positions"), asked)
    dots = found.groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") / F.col("word_count") * F.col("idf") * F.col("q")).alias("dot"))
    cosine = F.when((F.col("norm") > 0) & (F.col("q_norm") > 0), F.col("dot") / (F.col("norm") * F.col("q_norm"))).otherwise(0.0)
    rows = dots.join(ix.docs.select("doc_id", "norm"), "doc_id").join(asked_norm, "query_id")
    return top_k(rows.select("query_id", "doc_id", F.round(cosine, 6).alias("score")), k, "query_id")


def recency(created: Column, as_of: str) -> Column:
    """exp(-0.01 * age in days); 0.5 where the date is missing."""
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(created)) / 86400))
    return F.when(created.isNotNull(), F.exp(F.lit(-0.01) * age)).otherwise(0.5)


def tuned(
    ix: Index, queries: DataFrame, as_of: str, clicks: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, k: int = 10,
    boosts: DataFrame | None = None
) -> DataFrame:
    """query_id, doc_id, bm25_score, title_score, recency_score, click_score, score, rank. clicks: doc_id, clicks; boosts:
    query_id, doc_id, boost, added to the score of who asks."""
    parts = bm25_parts(ix, queries)
    asked = queries.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    docs = parts.groupBy("query_id", "doc_id").agg(
        F.sum("score").alias("bm25"), F.sum((F.col("field") == "title").cast("int")).alias("hits")
    ).join(asked, "query_id").join(ix.docs.select("doc_id", "created_at"), "doc_id")
    best = F.max("bm25").over(Window.partitionBy("query_id"))
    if clicks is None:
        docs = docs.withColumn("clicks", F.lit(0)).withColumn("most", F.lit(1))
    else:
        docs = docs.join(clicks, "doc_id", "left").crossJoin(F.broadcast(clicks.agg(F.max("clicks").alias("most")))).fillna(0, ["clicks"])
    docs = docs.withColumn("boost", F.lit(0.0)) if boosts is None else docs.join(boosts, ["query_id", "doc_id"], "left").fillna(0.0, ["boost"])
    signals = docs.select(
        "query_id",
        "doc_id",
        (F.col("bm25") / F.when(best > 0, best).otherwise(1.0)).alias("a"),
        (F.col("hits") / F.col("n_terms")).alias("b"),
        recency(F.col("created_at"), as_of).alias("c"),
        F.when(F.col("most") > 0, F.col("clicks") / F.col("most")).otherwise(0.0).alias("d"),
        "boost",
    )
    total = F.lit(weights[0]) * F.col("a") + F.lit(weights[1]) * F.col("b") + F.lit(weights[2]) * F.col("c") + F.lit(weights[3]) * F.col("d") + F.col("boost")
    named = (("a", "bm25"), ("b", "title"), ("c", "recency"), ("d", "click"))
    out = signals.select("query_id", "doc_id", *(F.round(x, 6).alias(f"{n}_score") for x, n in named), F.round(total, 6).alias("score"))
    return top_k(out, k, "query_id")


def personal_boost(clicks: DataFrame, by: float = 0.5) -> DataFrame:
    """session_id, doc, boost for each document that the user has clicked before."""
    return clicks.select("session_id", "query").distinct().withColumn("boost", F.lit(by))


def profile(searches: DataFrame, most: int = 100, clicks: DataFrame | None = None) -> DataFrame:
    """session_id, history: the last searches of each user, the newest first; with clicks, clicked as well: the last that was
    clicked."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))

    def newest(rows: DataFrame, name: str) -> DataFrame:
        last = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
        return last.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "query"))), lambda x: x["query"]).alias(name))

    out = newest(searches, "history")
    if clicks is None:
        return out
    none = F.array().cast("array<string>")
    return out.join(newest(clicks, "clicked"), "session_id", "full_outer").select(
        "session_id", F.coalesce("history", none).alias("history"), F.coalesce("clicked", none).alias("clicked")
    )
