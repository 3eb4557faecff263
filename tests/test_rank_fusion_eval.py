import math

import pytest
from pyspark.sql import functions as F

from spindrift.operators import evaluate, fusion, index, rank, rerank, vector


def col(spark, c):
    return spark.range(1).select(c).first()[0]


def test_bm25_parts(spark):
    lit = lambda x: F.lit(float(x))
    idf = [col(spark, rank.idf(lit(100), lit(d))) for d in (1, 50, 100)]
    assert idf == sorted(idf, reverse=True) and idf[-1] > 0
    tf = [col(spark, rank.tf_part(lit(t), lit(150), lit(150))) for t in (1, 5, 1000)]
    assert tf == sorted(tf) and tf[0] == pytest.approx(1.0) and tf[-1] < 2.5
    assert col(spark, rank.tf_part(lit(2), lit(50), lit(150))) > col(spark, rank.tf_part(lit(2), lit(500), lit(150)))


def test_ranking_of_many_queries(spark, corpus4):
    q = spark.createDataFrame(
        [(1, 0, "python"), (1, 1, "python"), (1, 2, "learning"), (2, 0, "nothing"), (3, 0, "basics")], "query_id int, place int, term string"
    )
    ix = index.Index.build(corpus4)
    got = rank.bm25(ix, q, 10).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.query_id, r.rank)) if r.query_id == 1] == [1, 3, 4]
    assert not [r for r in got if r.query_id == 2]
    assert [(r.doc_id, r.score) for r in got if r.query_id == 3] == [(1, 0.0)]
    t = rank.tuned(ix, q, "2025-01-01").where("query_id = 1").orderBy("rank").first()
    assert t.doc_id == 1 and t.bm25_score == 1.0 and t.title_score == round(1 / 3, 6) and t.recency_score == 0.5
    c = rank.tfidf(ix, q).where("query_id = 1").collect()
    assert c and all(0 <= r.score <= 1 for r in c)
    syn = spark.createDataFrame([(1, "web"), (2, "java")], "query_id int, term string")
    w = {(r.query_id, r.doc_id): r.score for r in rank.widened(ix, q, syn).collect()}
    assert w[2, 2] == 0.0 and {d for i, d in w if i == 1} == {1, 3, 4} and all(w[1, r.doc_id] == r.score for r in got if r.query_id == 1)
    boost = spark.createDataFrame([(1, 3, 5.0)], "query_id int, doc_id long, boost double")
    assert rank.tuned(ix, q, "2025-01-01", boosts=boost).where("query_id = 1").orderBy("rank").first().doc_id == 3


@pytest.fixture(scope="module")
def lists(spark):
    rows = [(0, 1, 1, 10.0, 1), (0, 1, 2, 8.0, 2), (0, 1, 3, 5.0, 3), (0, 2, 2, 0.9, 1), (0, 2, 1, 0.7, 2), (0, 2, 4, 0.5, 3)]
    return spark.createDataFrame(rows, "query_id int, list_id int, doc_id long, score double, rank int")


def scores(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_fusion_closed_forms(spark, lists):
    assert scores(fusion.rrf(lists))[1] == round(1 / 61 + 1 / 62, 6)
    one = lists.where("list_id = 1").withColumn("list_id", F.lit(3)).unionByName(lists.where("list_id = 1"))
    assert scores(fusion.rrf(one))[1] == round(2 / 61, 6)
    s, m = scores(fusion.combsum(lists)), scores(fusion.combmnz(lists))
    assert s[1] == 1.5 and s[2] == 1.6 and m[2] == 3.2 and m[3] == s[3] == 0.0
    b = scores(fusion.borda(lists))
    assert b[1] == b[2] == 3.0 and b[3] == b[4] == 0.0
    w = scores(fusion.weighted(lists, weights={1: 2.0, 2: 0.0}))
    assert w[1] == 1.0 and w[4] == 0.0
    assert scores(fusion.linear(lists)) == {k: round(v / 2, 6) for k, v in s.items()}
    flat = lists.withColumn("score", F.lit(3.0))
    assert set(scores(fusion.combsum(flat)).values()) == {0.0}
    order = lambda df: [r.doc_id for r in df.orderBy("rank").collect()]
    assert order(fusion.rrf(lists)) == order(fusion.rrf(lists.withColumn("list_id", 3 - F.col("list_id"))))


def test_metrics_closed_forms(spark):
    got = spark.createDataFrame(
        [("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 1, 12, 3), ("b", 1, 99, 1)], "system string, query_id int, doc_id long, rank int"
    )
    judged = spark.createDataFrame([(1, 10, 1.0), (1, 12, 1.0), (2, 5, 1.0), (3, 6, 0.0)], "query_id int, doc_id long, grade double")
    r = {(x.system, x.query_id): x for x in evaluate.per_query(got, judged).collect()}
    a = r["a", 1]
    assert a.precision_3 == pytest.approx(2 / 3) and a.recall_3 == 1.0 and a.mrr == 1.0 and a.map == pytest.approx((1 + 2 / 3) / 2)
    assert a.ndcg_1 == 1.0 and a.ndcg_3 == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)))
    assert r["b", 1].mrr == 0.0 and r["a", 2].recall_10 == 0.0 and ("a", 3) not in r
    assert all(r[k].recall_1 <= r[k].recall_3 <= r[k].recall_5 <= r[k].recall_10 for k in r)
    t = {x.metric: x for x in evaluate.table(got, judged, systems=["a", "b"]).collect()}
    assert t["mrr"].a == 0.5 and t["mrr"].b == 0.0


def test_vector_search_filters_first_and_takes_blocks(spark, monkeypatch):
    rows = [(i, [math.cos(i), math.sin(i)], i % 2) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = v.where("vec_id < 7").selectExpr("vec_id AS query_id", "embedding")
    want = {}
    for a in range(7):
        best = sorted((round(math.cos(a - b), 6), -b) for b, _, l in rows if l == 1 and round(math.cos(a - b), 6) >= 0)[::-1][:5]
        want[a] = [-b for _, b in best]
    run = lambda: {
        a: [
            r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == a
        ] for got in [vector.search(v, q, 5, where=F.col("label") == 1).collect()] for a in range(7)
    }
    assert run() == want
    monkeypatch.setattr(vector, "BLOCK", 6)
    assert run() == want
    assert vector.add(v, v.limit(3).unionByName(v.limit(1))).count() == 60


def test_reranker_and_labels(spark):
    d = spark.createDataFrame([("python web", "Python", "web tools")], "q string, t string, c string")
    assert d.select(rerank.jaccard_score(F.col("q"), F.col("t"), F.col("c"))).first()[0] == pytest.approx(2 / 3)
    assert col(spark, rerank.relevance_label(F.lit(0.6))) == "relevant" and col(spark, rerank.relevance_label(F.lit(0.1))) == "not_relevant"
    model = rerank.model_score(lambda q, t: (q == t).astype(float) * 10 - 5)
    assert d.select(model(F.col("q"), F.col("q"))).first()[0] > 0.99
