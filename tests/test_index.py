import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import index


def terms(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(T.terms(F.col("t"))).first()[0]


def test_terms_drop_stop_words_digits_short_and_long(spark):
    assert terms(spark, "The QUICK, brown_fox 123 a x é " + "y" * 51 + " v2 naïve") == ["quick", "brown", "fox", "v2", "naïve"]
    assert terms(spark, "") == [] and terms(spark, None) is None


def test_positions_count_dropped_tokens(spark, corpus4):
    p = index.postings(corpus4)
    row = p.where("term = 'python' AND doc_id = 1 AND field = 'body'").first()
    assert row.tf == 2 and row.positions == [0, 7]


def test_document_frequency_counts_both_fields_once(spark, corpus4):
    df = {r.term: r.df for r in index.document_frequency(index.postings(corpus4)).collect()}
    assert df["python"] == 2 and df["machine"] == 3 and df["basics"] == 1 and "the" not in df


def test_upsert_delete_and_snapshot(spark, corpus4):
    new = spark.createDataFrame([(1, "New", "Rust only", "test1", None), (9, "Nine", "Rust again", "test9", None)], corpus4.schema)
    after = index.upsert(index.delete(corpus4, corpus4.where("doc_id = 4")), new)
    snap = {r.term: r.doc_ids for r in index.snapshot(index.postings(after)).collect()}
    assert snap["rust"] == [1, 9] and snap["python"] == [3] and "statistics" not in snap


def test_stored_index_is_that_in_memory(spark, corpus4, tmp_path):
    i = index.Index.build(corpus4)
    back = index.Index.store(corpus4, str(tmp_path / "ix"), buckets=4)
    rows = lambda t, like: sorted(map(str, t.select(*like.columns).collect()))
    assert rows(back.postings, i.postings) == rows(i.postings, i.postings) and rows(back.terms, i.terms) == rows(i.terms, i.terms)
    assert (back.n, back.avgdl, back.buckets) == (i.n, i.avgdl, 4) and back.docs.count() == 4
    norms = {r.doc_id: r.norm for r in back.docs.collect()}
    assert norms == pytest.approx({r.doc_id: r.norm for r in i.docs.collect()}) and all(norms.values())
    assert [r.doc_id for r in back.posts("java").where("field = 'body'").collect()] == [2]


def test_a_query_reads_the_buckets_of_its_terms_alone(spark, corpus4, tmp_path, capsys):
    back = index.Index.store(corpus4, str(tmp_path / "ix"), buckets=16)
    back.posts("python").explain()
    assert "PartitionFilters: [isnotnull(bucket" in capsys.readouterr().out
    wanted = spark.createDataFrame([("python",)], "term string")
    back.of_terms(back.postings, wanted).explain()
    assert "PartitionFilters: [isnotnull(bucket" in capsys.readouterr().out


def test_similarity_and_sentences(spark):
    d = spark.createDataFrame([("a b c", "b c d", "One. Two! Three? four")], "x string, y string, z string")
    r = d.select(
        T.jaccard(T.token_set(F.col("x")), T.token_set(F.col("y"))), T.jaccard(T.bigrams(F.col("x")), T.bigrams(F.col("y"))),
        T.jaccard(T.token_set(F.lit("")), T.token_set(F.col("x"))), T.sentences(F.col("z"))
    ).first()
    assert r[0] == 0.5 and abs(r[1] - 1 / 3) < 1e-12 and r[2] == 0.0 and r[3] == ["One.", "Two!", "Three?", "four"]
