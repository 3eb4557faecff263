"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names:
every operator and every pipeline stage gives the result that its docstring defines."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import bpe, chat, fingerprint, html, linedup, neardup, packing, quality, shards, simhash, substrings

CLASH = [
    "row", "th", "fp", "k", "h", "starts", "spans", "removed", "n", "piece", "bin", "node", "component_id", "s", "first", "n_words", "kept", "hot",
    "named", "c", "d", "text_crc32", "k_doc", "f_th"
]
LONG = "\n".join(" ".join(f"w{i}x{j}" for j in range(8)) + "." for i in range(6000))


@pytest.fixture(scope="module")
def docs(spark):
    good = "\n".join(" ".join(f"good{i}{chr(97 + j)}" for j in range(9)) + "." for i in range(12))
    rows = [
        (1, good), (1, good), (1, good + " other"), (2, good), (None, good), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG),
        (8, "x"), (9, "x\ny\nz"), (10, "x\ny\nz")
    ]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_quality(docs, empty):
    got = quality.keep(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {1, 2, None, 6, 7} and got.count() == 7
    assert quality.keep(empty).count() == 0


def test_line_windows(docs, empty):
    got = linedup.clean(docs)
    assert got.count() == docs.count() and linedup.clean(empty).count() == 0
    by = [(r.row.doc_id, r.text) for r in got.collect()]
    assert ("own row" == got.select("row.row").first()[0]) and (10, "") in by and (9, "x\ny\nz") in by and (3, None) in by and (7, "") in by
    equal = [t for i, t in by if i == 1]
    assert len(equal) == 3 and (None, None) in by


def test_simhash(docs, empty):
    got = simhash.link(docs)
    assert got.count() == docs.count() and simhash.link(empty).count() == 0
    zero = [r.component_id for r in got.collect() if r.fp == 0]
    assert zero == [3] * 4
    left = neardup.dedup(docs)
    assert left.columns == docs.columns and neardup.dedup(empty).count() == 0
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 3, 6, 8, 9]


def test_substrings(docs, empty):
    got = substrings.clean(docs)
    assert got.count() == docs.count() and substrings.clean(empty).count() == 0
    by = {(r.row.doc_id, len(r.row.text or ""), r.text is None): r for r in got.collect()}
    assert by[7, len(LONG), False].text == "" and by[6, len(LONG), False].text == LONG
    assert (3, 0, True) in by


def test_fingerprints(docs, empty):
    got = fingerprint.edited(docs)
    assert got.count() == docs.count() and fingerprint.edited(empty).count() == 0
    one = fingerprint.edited(docs.where("doc_id = 8")).first()
    assert one.near_next == 1.0 and one.n_chars == 1
    prints = fingerprint.fingerprints(docs).collect()
    assert len({r.fingerprint for r in prints if r.doc_id in (3, 4)}) == 1


def test_bpe(docs, empty):
    got = bpe.digests(bpe.encode(docs, chunk=1000, overlap=100))
    assert got.count() == docs.count() and bpe.digests(bpe.encode(empty)).count() == 0
    assert {r.n_tokens for r in got.collect() if r.doc_id in (3, 4)} == {0}


def test_chat(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "b"), (None, 0, "user", ""), (2, 1, "assistant", LONG)
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(d)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 2, 2: 1} and got[2].loss_chars == len(LONG)
    assert chat.read_back(chat.format_chats(d.where("false"))).count() == 0


def test_shards(docs, empty):
    got = shards.assign(docs, 3).collect()
    assert len(got) == docs.count() and len({(r.shard, r.slot) for r in got}) == len(got) and shards.assign(empty, 3).count() == 0
    assert len({r.shard for r in got if r.doc_id == 1}) == 1


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    assert {(r.doc_id, r.length) for r in got if r.doc_id in (3, 4)} == {(3, 1), (4, 1)} and packing.pack(empty).count() == 0
    assert sum(r.piece == 0 for r in got) == docs.count()


def test_html(spark):
    d = spark.createDataFrame(
        [(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "<p>" + LONG)], "page_id long, url string, html string"
    ).withColumn("text", F.lit("own"))
    got = html.extract_pages(d).collect()
    assert len(got) == 4 and {r.n_chars for r in got if r.page_id in (1, None)} == {0} and html.extract_pages(d.where("false")).count() == 0
    assert got[-1].text == " ".join(LONG.split())


def test_pipeline_stages(spark, docs, empty):
    assert sum(
        r.piece == 0 for r in corpus_pipeline.pack(spark, docs, "").collect()
    ) == docs.count() and corpus_pipeline.pack(spark, empty, "").count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs, "").count() <= docs.count() and stage(spark, empty, "").count() == 0
