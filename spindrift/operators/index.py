"""The inverted index as tables: postings, document frequencies, corpus statistics, and their upkeep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import store


def with_counts(corpus: DataFrame) -> DataFrame:
    """corpus with word_count, the indexed tokens of the body."""
    return corpus.withColumn("word_count", F.size(T.terms(F.col("body"))))


def occurrences(corpus: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns asked for, field, pos, term of every indexed token of title and body."""
    fields = F.array(
        F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("body").alias("field"), F.col("body").alias("text"))
    )
    return T.positions(
        corpus.select("doc_id", *more, F.explode(fields).alias("f")).select("doc_id", *more, "f.field", "f.text"), "text", "doc_id", *more, "field"
    )


def postings(corpus: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """term, doc_id, field, tf, positions; of the terms in `only`, if it is given."""
    rows = occurrences(corpus)
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "doc_id", "field").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def document_frequency(posts: DataFrame) -> DataFrame:
    """term, df: documents with the term in either field."""
    return posts.select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(counted: DataFrame) -> DataFrame:
    """One row: n documents, avgdl (0 without documents)."""
    return counted.agg(F.count("*").alias("n"), F.coalesce(F.avg("word_count"), F.lit(0.0)).alias("avgdl"))


def snapshot(posts: DataFrame) -> DataFrame:
    """term, doc_ids in order."""
    return posts.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def vocabulary(posts: DataFrame) -> DataFrame:
    return posts.select("term").distinct()


def index_stats(counted: DataFrame, posts: DataFrame, pages: DataFrame) -> DataFrame:
    """documents, terms, postings, pages, avg_doc_length in one row."""
    a = counted.agg(F.count("*").alias("documents"), F.round(F.coalesce(F.avg("word_count"), F.lit(0.0)), 1).alias("avg_doc_length"))
    p = posts.agg(F.count("*").alias("postings"))
    t = posts.select("term").distinct().agg(F.count("*").alias("terms"))
    return a.crossJoin(t).crossJoin(p).crossJoin(pages.agg(F.count("*").alias("pages")))  # one row each


def upsert(corpus: DataFrame, changed: DataFrame) -> DataFrame:
    """corpus with the documents of `changed` put in place of those of the same doc_id, or added."""
    return corpus.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed)


def delete(corpus: DataFrame, gone: DataFrame) -> DataFrame:
    return corpus.join(gone.select("doc_id"), "doc_id", "left_anti")


BUCKETS = 32


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """What queries read instead of texts. docs: doc_id, title, source, created_at, word_count, norm (of the TF-IDF vector of
    the body); postings: term, doc_id, field, tf, positions, word_count; terms: term, df (documents with it in either
    field), body_df. Of a stored index, postings and terms are in files by `bucket`, a hash of the term, in order of term,
    so that a query reads the files of its terms."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    buckets: int = 0

    @classmethod
    def build(cls, corpus: DataFrame, buckets: int = 0) -> Index:
        """The tables of corpus (doc_id, title, body, source, created_at); nothing is computed yet but n and avgdl."""
        counted = with_counts(corpus)
        n, avgdl = counted.agg(F.count("*"), F.coalesce(F.avg("word_count"), F.lit(0.0))).first()
        posts = postings(corpus).join(counted.select("doc_id", "word_count"), "doc_id")
        return cls._of(counted, posts, n, avgdl, buckets)

    @classmethod
    def _of(cls, counted: DataFrame, posts: DataFrame, n: int, avgdl: float, buckets: int) -> Index:
        key = ["bucket", "term"] if buckets else ["term"]
        per_doc = posts.groupBy(*key, "doc_id").agg(F.max((F.col("field") == "body").cast("int")).alias("body"))
        terms = per_doc.groupBy(*key).agg(F.count("*").alias("df"), F.sum("body").alias("body_df"))
        return cls(cls._docs(counted, posts, terms, n, key), posts, terms, n, avgdl, buckets)

    @staticmethod
    def _docs(counted: DataFrame, posts: DataFrame, terms: DataFrame, n: int, key: list[str]) -> DataFrame:
        body = posts.where("field = 'body'").select(*key, "doc_id", "tf", "word_count").join(terms.select(*key, "body_df"), key)
        weight = F.col("tf") / F.col("word_count") * F.log(F.lit(float(n)) / F.col("body_df"))
        norms = body.groupBy("doc_id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
        return counted.drop("body").join(norms, "doc_id", "left").fillna(0.0, ["norm"])

    @classmethod
    def store(cls, corpus: DataFrame, path: str, buckets: int = BUCKETS, spread: int = 4) -> Index:
        """Builds the index in files below path. Occurrences are shuffled once, by bucket and, so that a frequent term isn't
        one task, by a hash of the document; that order is kept for grouping and writing."""
        spark = corpus.sparkSession
        counted = with_counts(corpus)
        part = F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int")
        rows = occurrences(counted, "word_count").withColumns({"bucket": bucket(F.col("term"), buckets), "part": part}).repartition(buckets * spread, "bucket", "part")
        posts = rows.groupBy("bucket", "part", "term", "doc_id", "field", "word_count").agg(
            F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")
        )
        posts.drop("part").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        n, avgdl = counted.agg(F.count("*"), F.coalesce(F.avg("word_count"), F.lit(0.0))).first()
        posts = _read(spark, f"{path}/postings", "word_count int, term string, doc_id long, field string, tf long, positions array<int>, bucket int")
        made = cls._of(counted, posts, n, avgdl, buckets)
        made.terms.repartition(min(buckets, 8), "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        terms = _read(spark, f"{path}/terms", "term string, df long, body_df long, bucket int")
        cls._docs(counted, posts, terms, n, ["bucket", "term"]).write.mode("overwrite").parquet(f"{path}/docs")
        spark.createDataFrame([(n, float(avgdl), buckets)], "n long, avgdl double, buckets int").write.mode("overwrite").parquet(f"{path}/stats")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        n, avgdl, buckets = spark.read.parquet(f"{path}/stats").select("n", "avgdl", "buckets").first()
        return cls(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), n, avgdl, buckets)

    def of_terms(self, table: DataFrame, wanted: DataFrame) -> DataFrame:
        """The rows of postings or terms that meet wanted (term, any more). The buckets of few terms are looked up, so that
        only their files are read."""
        wanted = store.kept(wanted)
        n = wanted.count()
        if not self.buckets:
            return table.join(F.broadcast(wanted) if n <= store.SMALL else wanted, "term")
        wanted = wanted.withColumn("bucket", bucket(F.col("term"), self.buckets))
        if n <= 1000:
            table = table.where(F.col("bucket").isin([r[0] for r in wanted.select("bucket").distinct().collect()] or [-1]))
        return table.join(F.broadcast(wanted) if n <= store.SMALL else wanted, ["bucket", "term"]).drop("bucket")

    def posts(self, term: str) -> DataFrame:
        """The postings of one term, from the files of its bucket alone."""
        rows = self.postings.where(F.col("term") == term)
        return rows.where(F.col("bucket") == bucket(F.lit(term), self.buckets)) if self.buckets else rows

    def posts_of_document(self, doc_id: int) -> DataFrame:
        return self.postings.where(F.col("doc_id") == doc_id)

    def term_df(self, queries: DataFrame) -> DataFrame:
        """query_id, term, df, body_df of the distinct terms of queries (query_id, term) that the index has."""
        return self.of_terms(self.terms, queries.select("query_id", "term").distinct())


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
