"""Line dedup by overlapping three-line windows: windows of consecutive lines are hashed, repeated windows found globally,
and every occurrence but the first is removed by merging the lines that such windows cover. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, shared, small, table

WINDOW = 3


def _said(lines: Column) -> Column:
    """(i, text) of the lines that hold more than white space."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda p: p["x"].rlike("[^\\x20\\x09-\\x0D]"))


def _hashes(said: Column, size: int) -> Column:
    """Two 64-bit hashes of each window of `size` lines."""
    at = F.sequence(F.lit(0), F.size(said) - size)
    line = lambda k, j: F.get(said, k + j)["x"]
    both = F.transform(
        at,
        lambda k: F.struct(
            F.xxhash64(*[line(k, j) for j in range(size)]).alias("h1"), F.xxhash64(F.lit(1), *[line(k, j) for j in reversed(range(size))]).alias("h2")
        )
    )
    return F.when(F.size(said) >= size, both)


def first_places(windows: DataFrame, keys: list[str], *place: str) -> DataFrame:
    """The rows of windows (the keys, place, any more), a written table, that aren't the first of their key in the order of
    the struct of place.

    Keys are counted first, which needs no order and is summed up in each task; only the rows of keys that are there twice
    or more are put in order. A key with a large share of the rows is joined by broadcast."""
    twice = shared(windows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))
    again = shared(hot_join(windows, twice, keys, "n", windows.count()))
    first = shared(again.groupBy(*keys).agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")))
    return hot_join(again, first, keys, "n", again.count()).where(~F.struct(*place).eqNullSafe(F.col("first"))).drop("first")


def find(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, th (hash of the text), starts (array of the places, among the lines with a word, of windows that occurred
    before) for each document of docs (doc_id, text) that has some. The order of occurrences is that of (doc_id, th,
    place), null doc_id first."""
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), _said(F.split(F.coalesce("text", F.lit("")), "\n")).alias("said"))
    windows = shared(base.select(
        "doc_id", "th", F.posexplode(_hashes(F.col("said"), size)).alias("k", "h")
    ).select("doc_id", "th", "k", "h.h1", "h.h2"))
    later = first_places(windows, ["h1", "h2"], "doc_id", "th", "k")
    return later.groupBy("doc_id", "th").agg(F.collect_set("k").alias("starts"))


def with_found(rows: DataFrame, found: DataFrame, many: str) -> DataFrame:
    """rows (row, th) with the columns of found (doc_id, th, many: an array), a written table, or nulls. It is broadcast if it
    and its arrays are small; beyond that the rows meet it by a shuffle."""
    n = found.agg(F.count("*") + F.coalesce(F.sum(F.size(many)), F.lit(0))).first()[0]
    named = small(found.select(F.col("doc_id").alias("f_doc"), F.col("th").alias("f_th"), many), n)
    return rows.join(named, F.col("row.doc_id").eqNullSafe(F.col("f_doc")) & (F.col("th") == F.col("f_th")), "left")


def clean(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """row (a struct of all columns of docs), text (without the removed lines), n_lines, n_removed, removed (array of line
    numbers from 0), one for each row of docs (doc_id, text, any more).

    Lines are \\n-separated; lines without a word are in no window and stay. Null text stays null and has no lines; equal
    rows (doc_id and text) count as one document and share their fate, other rows that share a doc_id are told apart by
    their text; a text of fewer lines with a word than a window is unchanged; an empty table gives an empty one."""
    joined = with_found(docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("th")), shared(find(docs, size)), "starts")
    # Every row that had no window before goes through as it is; only the others are split again.
    lines = F.split("row.text", "\n")
    cut = joined.select(
        "row", lines.alias("lines"),
        F.when(
            F.col("starts").isNotNull(),
            F.sort_array(F.array_distinct(F.flatten(F.transform(
                "starts", lambda k: F.transform(F.slice(_said(lines), k + 1, size), lambda p: p["i"])
            ))))
        ).alias("removed")
    )
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"), lambda i: F.get("lines", i))
    return cut.select(
        "row",
        F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "row.doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("n_removed") > 0, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines")
    )


OP6_SQL = r"""
WITH l AS (SELECT doc_id, i, x FROM (
    SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
s AS (SELECT doc_id, i, trim(x, ' ') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.k, a.x || chr(10) || b.x || chr(10) || c.x AS h FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN s c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
o AS (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS n FROM w),
c AS (SELECT DISTINCT s.doc_id, s.i FROM o JOIN s ON s.doc_id = o.doc_id AND s.k BETWEEN o.k AND o.k + 2 WHERE o.n > 1),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS at FROM c GROUP BY doc_id),
t AS (SELECT l.doc_id, count(*) AS n, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL) AS text FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, CAST(coalesce(t.n, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.at, '') AS removed_lines
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
"""
