"""Vector search: exact inner product of unit vectors, filtered search, best chunk per document, latest-wins upkeep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import top_k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(store: DataFrame, new: DataFrame) -> DataFrame:
    """store with the vectors of `new` whose vec_id it doesn't have; equal ids in `new` count once."""
    return store.unionByName(new.dropDuplicates(["vec_id"]).join(store.select("vec_id"), "vec_id", "left_anti"))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    return store.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new)


def remove(store: DataFrame, gone: DataFrame) -> DataFrame:
    return store.join(gone.select("vec_id"), "vec_id", "left_anti")


#: Floats of queries that one pass over the vectors holds in each task.
BLOCK = 4_000_000


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The vectors of a batch as rows of unit length; a null vector is one of zeros."""
    lists = batch.column(column).cast(pa.large_list(pa.float64()))
    width = max((len(x) for x in lists if x.is_valid), default=0) if lists.null_count else (len(lists.values) // max(len(lists), 1))
    if lists.null_count:
        x = np.array([v if v is not None else [0.0] * width for v in lists.to_pylist()], np.float64).reshape(len(lists), width)
    else:
        x = lists.flatten().to_numpy().reshape(len(lists), width)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def search(store: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0, where: Column | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the k vectors most similar to each query (query_id, embedding), by cosine, of score
    `least` or more. A filter holds before the cut, so k results are found if there are as many.

    The queries, a set the caller states, meet each batch of vectors in one matrix product; each batch keeps its k best
    per query. Sets of more than a block are dealt into blocks by a hash of their id; each block is one pass over the
    vectors, and the block alone is sent out."""
    spark = store.sparkSession
    kept = (store if where is None else store.where(where)).select("vec_id", "embedding")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where("embedding IS NOT NULL")
    n, width = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n * (width or 1) // BLOCK))
    found = None
    for block in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
        if part.num_rows:
            rows = part.combine_chunks().to_batches()[0]
            sent = spark.sparkContext.broadcast((rows.column("query_id").to_numpy(), _matrix(rows, "embedding")))
        else:
            sent = spark.sparkContext.broadcast((np.array([], np.int64), np.zeros((0, 0))))

        def run(batches, sent=sent):
            ids, m = sent.value
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                x, vec = _matrix(b, "embedding"), b.column("vec_id").to_numpy()
                for i in range(0, len(ids), 256):
                    score = np.round(m[i : i + 256] @ x.T, 6)
                    q, v = [], []
                    for r, row in enumerate(score):
                        ok = np.flatnonzero(row >= least)
                        best = ok[np.lexsort((vec[ok], -row[ok]))[:k]]
                        q.append(np.full(len(best), r))
                        v.append(best)
                    q, v = np.concatenate(q), np.concatenate(v)
                    yield pa.record_batch([pa.array(ids[i + q]), pa.array(vec[v]), pa.array(score[q, v])], ["query_id", "vec_id", "score"])

        got = kept.mapInArrow(run, "query_id long, vec_id long, score double")
        found = got if found is None else found.unionByName(got)
    return top_k(found, k, "query_id", tie="vec_id")


def best_chunk(hits: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, vec_id, score, rank: of each document the best of its chunks (vec_id, doc_id) among the hits."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "vec_id")
    best = hits.drop("rank").join(chunks.select("vec_id", "doc_id"), "vec_id").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return top_k(best, k, "query_id")


def index_stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("total_vectors"), F.max(F.size("embedding")).alias("dimension"))


def chunk_stats(chunks: DataFrame, docs: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks, embedded_docs, docs, cached in one row: of chunks (doc_id, vec_id), docs (doc_id) and the embedding cache."""
    c = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("embedded_docs"))
    return c.crossJoin(docs.agg(F.count("*").alias("docs"))).crossJoin(cache.agg(F.count("*").alias("cached")))  # one row each


def for_tenant(store: DataFrame, tenant: str) -> DataFrame:
    """The vectors of one tenant (tenant_id, vec_id, embedding), by the names its own queries use: what other tenants have isn't
    searched, and equal ids don't meet."""
    return store.where(F.col("tenant_id") == tenant).drop("tenant_id")
