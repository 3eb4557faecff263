"""Chunking and embedding: word windows, content hashes, what is still to be embedded, and a deterministic embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import store

SIZE, OVERLAP, LEAST = 256, 32, 10


def _rows(docs: DataFrame, text: str, windows: Column, whole: Column) -> DataFrame:
    """doc_id, chunk_id, chunk_index, start_offset, end_offset, word_count, text."""
    base = docs.select("doc_id", F.col(text).alias("text"), T.words(F.col(text)).alias("w"))
    made = base.withColumn("n", F.size("w")).withColumn("x", windows)
    one = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"), F.lit(True).alias("whole")))
    some = F.transform("x", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("whole")))
    rows = made.select("doc_id", "text", "w", F.posexplode(F.when(whole, one).otherwise(some)).alias("i", "s"))
    said = F.when(F.col("s.whole"), F.trim("text")).otherwise(F.array_join(F.expr("slice(w, s.start + 1, s.end - s.start)"), " "))
    return rows.select(
        "doc_id", F.concat_ws("_", "doc_id", "i").alias("chunk_id"), F.col("i").alias("chunk_index"), F.col("s.start").alias("start_offset"),
        F.col("s.end").alias("end_offset"), (F.col("s.end") - F.col("s.start")).alias("word_count"), said.alias("text")
    )


def _windows(step: int, size: int) -> Column:
    n = F.col("n")
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))
    ).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def fixed(docs: DataFrame, text: str = "text", size: int = SIZE, least: int = LEAST) -> DataFrame:
    """Windows side by side; a last one of fewer than `least` words is left out, but a text too short for one is a chunk."""
    kept = F.filter(_windows(size, size), lambda x: x["end"] - x["start"] >= least)
    return _rows(docs, text, kept, (F.size("x") == 0) & (F.col("n") > 0))


def sliding(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Overlapping windows up to the first that reaches the end; a text no longer than one is a chunk as it is."""
    step = max(1, size - min(overlap, size - 1))
    kept = F.filter(
        _windows(step, size), lambda x: (x["end"] - x["start"] >= least) & ((x["start"] == 0) | (x["start"] + (size - step) < F.col("n")))
    )
    return _rows(docs, text, kept, F.col("n") <= size)


def chunk(docs: DataFrame, strategy: str = "sliding_window", **how) -> DataFrame:
    return fixed(docs, **how) if strategy == "fixed" else sliding(docs, **how)


def content_hash(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model + "|"), text), 256)


def missing(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Chunks whose text the cache (content_hash) doesn't have, one row for each text."""
    keyed = chunks.withColumn("content_hash", content_hash(model, F.col("text"))).dropDuplicates(["content_hash"])
    return keyed.join(cache.select("content_hash"), "content_hash", "left_anti")


def unembedded(docs: DataFrame, embedded: DataFrame) -> DataFrame:
    return docs.select("doc_id").join(embedded.select("doc_id"), "doc_id", "left_anti")


def embed(dimension: int = 384):
    """A stand-in for a model: a unit Gaussian vector seeded by the text's SHA-256. The same text, the same vector."""

    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        def one(t: str):
            seed = int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).standard_normal(dimension)
            return (v / np.linalg.norm(v)).astype(np.float32)

        return text.map(one)

    return run


# What families of embedding models put before a query and before a passage.
PREFIXES = {"bge": ("Represent this sentence for searching relevant passages: ", ""), "e5": ("query: ", "passage: ")}


def prefixed(text: Column, family: str, query: bool) -> Column:
    """text as a model of the family (else as it is) reads a query or a passage."""
    return F.concat(F.lit(PREFIXES.get(family, ("", ""))[0 if query else 1]), text)


def model_embed(
    load: Callable[[], Callable[[list[str]], np.ndarray]], family: str = "", query: bool = False, size: int = 32
) -> Callable[[Column], Column]:
    """An embedding model as a column: loaded once in a task, texts in batches, unit vectors out."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for t in texts:
            made = [np.asarray(model(t.iloc[at : at + size].tolist()), np.float64) for at in range(0, len(t), size)]
            x = np.concatenate(made) if made else np.zeros((0, 1))
            yield pd.Series(list((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)))

    return lambda text: run(prefixed(text, family, query))


def embed_missing(
    chunks: DataFrame, cache: DataFrame, model: str = "mock", dimension: int = 384, embedder: Callable[[Column], Column] | None = None
) -> DataFrame:
    """content_hash, embedding to append to the cache."""
    return missing(chunks, cache, model).select("content_hash", (embedder or embed(dimension))(F.col("text")).alias("embedding"))


def embed_documents(
    docs: DataFrame, stored: DataFrame, cache: DataFrame, model: str = "mock", strategy: str = "fixed", dimension: int = 384,
    embedder: Callable[[Column], Column] | None = None
) -> DataFrame:
    """chunk_id, doc_id, chunk_index, text, content_hash, embedding, cached of the chunks of docs (doc_id, text) that `stored`
    (doc_id) doesn't have: the vectors to store. A text that the cache (content_hash, embedding) has isn't embedded
    again, and one that several chunks have is embedded once."""
    new = docs.join(stored.select("doc_id").distinct(), "doc_id", "left_anti")
    parts = store.kept(chunk(new, strategy).withColumn("content_hash", content_hash(model, F.col("text"))))
    made = embed_missing(parts.select("text"), cache, model, dimension, embedder).withColumn("cached", F.lit(False))
    known = cache.select("content_hash", "embedding").dropDuplicates(["content_hash"]).withColumn("cached", F.lit(True))
    return parts.join(made.unionByName(known), "content_hash").select(
        "chunk_id", "doc_id", "chunk_index", "text", "content_hash", "embedding", "cached"
    )


def of_document(docs: DataFrame, doc_id: int, **how) -> DataFrame:
    """The chunks of one document, in order."""
    return chunk(docs.where(F.col("doc_id") == doc_id), **how).orderBy("chunk_index")
