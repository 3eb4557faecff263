"""From raw documents to packed training sequences: quality rules, line dedup, SimHash near-dedup, substring dedup and
best-fit packing, each stage on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import linedup, neardup, packing, quality, substrings
from spindrift.llm.common import shared, table


def _with_text(cleaned: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents with the cleaned text and its length."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cleaned.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a rule of quality.CORPUS_RULES rejects go, the others stay as they are. Null and empty texts go; repeated
    rows share their fate; extra columns stay; an empty table gives an empty one."""
    return quality.keep(docs, quality.CORPUS_RULES)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without the lines of windows that occurred before. Null text stays null; equal rows count as one
    document; a text all of which is repeated is left empty; an empty table gives an empty one."""
    return _with_text(linedup.clean(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, as it is: that with the smallest doc_id, null last. Texts without
    words are one group; equal rows leave one; an empty table gives an empty one."""
    return neardup.dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without the spans that occurred before. Null text stays null; equal rows count as one document; an
    empty table gives an empty one."""
    return _with_text(substrings.clean(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: see packing.pack. Null text: empty, one id; repeated rows: pieces of their own; an empty table
    gives an empty one."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", pack),
]

#: The hashes and token ids of the later stages have no SQL equivalent; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
