"""Substring dedup by hashing units of text: lines are normalised, their digests grouped globally, the earliest occurrence in
the order of documents stays, and every later one goes, with its offsets in the original retained. A further stage does the
same with runs of parts of sentences, for passages that stand in the middle of lines."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_arrow, shared, table
from .linedup import with_found

#: Ends of units. For passages inside lines, a line is cut into its sentences, and these before each capitalised word, where
#: a passage may begin.
UNITS = {
    "sentence": r"(?<=[.!?…。！？])\s+|[^\S\n]*\n\s*|[^\S\n]+(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])", "line": r"[^\S\n]*\n\s*", "paragraph": r"\s*\n[^\S\n]*\n\s*"
}
#: Words from which a line or paragraph is a passage, and not a phrase that many texts have; words of a part of a sentence
#: that is hashed (shorter ones go with those around them), and of a run of parts that is removed.
UNIT_WORDS, PART_WORDS, RUN_WORDS = 15, 3, 25
#: Units that a task puts in order at a time.
HELD = 500_000


def units(text: str, ends: re.Pattern, least: int, seed: int = 0) -> list[tuple[int, int, int, int]]:
    """(start, end, words, 128-bit digest) of every unit of at least so many words."""
    out, at = [], 0
    for a, b in [*((m.start(), m.end()) for m in ends.finditer(text)), (len(text), len(text))]:
        words = text[at:a].lower().split()
        if len(words) >= least:
            out.append((at, a, len(words), xxhash.xxh3_128_intdigest(" ".join(words).encode(), seed)))
        at = b
    return out


def runs(found: list[tuple[int, int, int, int]], least: int) -> list[tuple[int, int]]:
    """Spans of the runs of consecutive later occurrences (j, start, end, words) that have at least so many words."""
    out, own = [], []
    for x in [*sorted(found), None]:
        if own and (x is None or x[0] != own[-1][0] + 1):
            if sum(u[3] for u in own) >= least:
                out.append((own[0][1], own[-1][2]))
            own = []
        own.append(x)
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def find(
    docs: DataFrame, unit: str = "line", unit_words: int = UNIT_WORDS, parts: bool = True, part_words: int = PART_WORDS, run_words: int = RUN_WORDS
) -> DataFrame:
    """doc_id, th (hash of the text), spans array<struct<start, end>> (code points of the original text) for each document
    of docs (doc_id, text) that repeats an earlier one, or itself: every later occurrence of a unit and, with parts, runs
    of later occurrences of parts of sentences. Earlier is in the order of (doc_id, th, place), null doc_id first."""
    kinds = [(unit, unit_words)] + [("sentence", part_words)] * parts

    def cut(batches):
        """The units, those of HELD at a time in order: what has an earlier one among them is later for sure, so at most one row
        of a digest, however frequent, is left of them to be compared with those of other tasks."""
        ends = [(re.compile(UNITS[u]), least) for u, least in kinds]
        held: list[pa.RecordBatch] = []
        names = ["doc_id", "th", "kind", "j", "d1", "d2", "a", "e", "words"]

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            doc, th, _, j, d1, d2 = (t.column(i).chunk(0) if t.num_rows else pa.array([], pa.int64()) for i in range(6))
            key = [x.to_numpy() for x in (d1, d2)]
            order = np.lexsort((j.to_numpy(), th.to_numpy(), doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), *key[::-1]))
            same = np.zeros(len(order), bool)
            same[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in key])
            sure = np.empty(len(order), bool)
            sure[order] = same
            t = t.append_column("sure", pa.array(sure))
            yield from t.to_batches(10_000)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                own = b.slice(at, 256)
                got = [[
                    (kind, j, *u) for kind, (pattern, least) in enumerate(ends) for j, u in enumerate(units(t, pattern, least, kind))
                ] for t in own.column("text").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]))
                flat = [u for x in got for u in x]
                digest = np.frombuffer(b"".join(u[5].to_bytes(16, "little") for u in flat), "<i8").reshape(-1, 2)
                num = lambda k: pa.array([u[k] for u in flat], pa.int32())
                held.append(pa.record_batch(
                    [
                        own.column("doc_id").take(row), own.column("th").take(row), num(0), num(1), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                        num(2), num(3), num(4)
                    ],
                    names
                ))
                if sum(x.num_rows for x in held) >= HELD:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    def merge(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            got = []
            for found in b.column("found").to_pylist():
                whole = [(x["a"], x["e"]) for x in found if x["kind"] == 0]
                got.append([
                    {"start": a, "end": e} for a,
                    e in union(whole + runs([(x["j"], x["a"], x["e"], x["words"]) for x in found if x["kind"] == 1], run_words))
                ])
            yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(got, kind)], ["doc_id", "th", "spans"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    every = shared(base.transform(by_arrow, cut, "doc_id long, th long, kind int, j int, d1 long, d2 long, a int, e int, words int, sure boolean"))
    place = Window.partitionBy("d1", "d2").orderBy("doc_id", "th", "j")
    open_ = every.where("NOT sure").withColumn("place", F.row_number().over(place)).where("place > 1").drop("place")
    later = every.where("sure").unionByName(open_)
    held = later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("kind", "j", "a", "e", "words")).alias("found"))
    return held.transform(by_arrow, merge, "doc_id long, th long, spans array<struct<start: int, end: int>>").where(F.size("spans") > 0)


def clean(docs: DataFrame, **how) -> DataFrame:
    """row (a struct of all columns of docs), text (without the spans), spans (those removed, in code points of the
    original text), one for each row of docs (doc_id, text, any more).

    Null text stays null; a text all of which is repeated is left empty; equal rows (doc_id and text) count as one document
    and share their fate; other rows that share a doc_id are told apart by their text; an empty table gives an empty one."""
    joined = with_found(docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("th")), shared(find(docs, **how)), "spans")
    text, n = F.col("row.text"), F.size("spans")
    # What stands before each span, and after the last.
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"])
    end = lambda i: F.coalesce(F.get("spans", i)["start"], F.length(text))
    left = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, begin(i) + 1, end(i) - begin(i))), "")
    none = F.array().cast("array<struct<start: int, end: int>>")
    return joined.select("row", F.when(F.col("spans").isNull(), text).otherwise(left).alias("text"), F.coalesce("spans", none).alias("spans"))


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return got.select(
        "row.doc_id", F.size("spans").cast("long").alias("n_spans"), cut.alias("removed_chars"),
        F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",").alias("spans"),
        "text"
    )


OP2_SQL = r"""
WITH m AS (SELECT doc_id, 1 AS kind, text, string_split(regexp_replace(text, '([.!?…。！？])(\s+)|([ \t\r\f\v]*\n\s*)|([ \t\r\f\v]+)([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])', '\1' || chr(1) || '\2\3\4' || chr(2) || '\5', 'g'), chr(2)) AS ps FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 0, text, string_split(regexp_replace(text, '([ \t\r\f\v]*\n\s*)', chr(1) || '\1' || chr(2), 'g'), chr(2)) FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, kind, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM m),
s AS (SELECT doc_id, kind, i, string_split(p, chr(1))[1] AS unit, length(replace(p, chr(1), '')) AS size FROM p),
o AS (SELECT doc_id, kind, i, unit, coalesce(sum(size) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s),
w AS (SELECT doc_id, kind, i, a, a + length(unit) AS e, list_filter(string_split_regex(lower(unit), '\s+'), lambda x: x <> '') AS ws FROM o),
u AS (SELECT doc_id, kind, a, e, len(ws) AS n, array_to_string(ws, ' ') AS said, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS j FROM w WHERE len(ws) >= CASE kind WHEN 0 THEN 15 ELSE 3 END),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, said ORDER BY doc_id, j) AS seen FROM u) WHERE seen > 1),
g AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS run FROM l WHERE kind = 1),
r AS (SELECT doc_id, CAST(min(a) AS BIGINT) AS a, CAST(max(e) AS BIGINT) AS e FROM g GROUP BY doc_id, run HAVING sum(n) >= 25
  UNION ALL SELECT doc_id, CAST(a AS BIGINT), CAST(e AS BIGINT) FROM l WHERE kind = 0),
x AS (SELECT *, CASE WHEN a <= max(e) OVER (PARTITION BY doc_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM x),
z AS (SELECT doc_id, min(a) AS a, max(e) AS e FROM y GROUP BY doc_id, span),
k AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM z),
c AS (SELECT k.doc_id, count(*) AS n_spans, CAST(sum(e - a) AS BIGINT) AS removed_chars, string_agg(a || '-' || e, ',' ORDER BY a) AS spans, string_agg(substr(d.text, b + 1, a - b), '' ORDER BY a) AS head, max(e) AS last
  FROM k JOIN documents d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n_spans, 0) AS n_spans, coalesce(removed_chars, 0) AS removed_chars, coalesce(spans, '') AS spans, CASE WHEN c.doc_id IS NULL THEN d.text ELSE head || substr(d.text, last + 1) END AS text
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id
"""
