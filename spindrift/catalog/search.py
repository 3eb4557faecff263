"""Queries on the index: tokens, postings, Boolean retrieval, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index, rank
from ..plans import query_language as Q
from ..sources import store
from ..sources import tables as S
from . import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


TOPICS = ((1, "tion"), (1, "ther"), (2, "ing"), (2, "ble"), (2, "thon"), (3, "erre"))
TOPICS_SQL = "queries AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {n}, '{t}')" for n, (i, t) in enumerate(TOPICS)) + ") AS v(query_id, place, term))"


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(TOPICS)], "query_id int, place int, term string")


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = S.corpus(spark, sf_dir)
    return c, index.with_counts(c)


def index_of(spark: SparkSession, sf_dir: str) -> index.Index:
    """The stored index of the documents: built by the first query of an application that needs it, read by the others."""
    return store.held(spark, "index", sf_dir, lambda: index.Index.store(S.corpus(spark, sf_dir), store.new_dir(spark, "index")))


# -- index


@query("tokenize_counts",
    f"WITH {sql.DOCS} SELECT doc_id, CAST(len({sql.raw('body')}) AS BIGINT) AS raw_tokens, CAST(len({sql.terms('body')}) AS BIGINT) "
    f"AS terms, CAST(len(list_distinct({sql.terms('body')})) AS BIGINT) AS distinct_terms FROM docs"
)
def tokenize_counts(spark, d):
    b = F.col("body")
    return S.corpus(spark, d).select(
        "doc_id", F.size(T.raw_tokens(b)).cast("long").alias("raw_tokens"), F.size(T.terms(b)).cast("long").alias("terms"),
        F.size(F.array_distinct(T.terms(b))).cast("long").alias("distinct_terms")
    )


@query("postings_tf",
    f"WITH {sql.DOCS}, {sql.OCC} SELECT term, doc_id, field, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) "
    f"AS positions FROM occ GROUP BY term, doc_id, field"
)
def postings_tf(spark, d):
    return index.postings(S.corpus(spark, d)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("doc_freq", f"WITH {sql.INDEX} SELECT term, count(DISTINCT doc_id) AS df FROM posts GROUP BY term")
def doc_freq(spark, d):
    return index.document_frequency(index.postings(S.corpus(spark, d)))


@query("corpus_stats", f"WITH {sql.DOCS}, {sql.COUNTED}, {sql.STATS} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, d):
    return index.corpus_stats(_base(spark, d)[1]).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("index_snapshot",
    f"WITH {sql.INDEX} SELECT term, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM (SELECT DISTINCT "
    f"term, doc_id FROM posts) GROUP BY term"
)
def index_snapshot(spark, d):
    return index.snapshot(index.postings(S.corpus(spark, d))).select(
        "term", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids")
    )


@query("vocabulary", f"WITH {sql.INDEX} SELECT DISTINCT term FROM posts")
def vocabulary(spark, d):
    return index.vocabulary(index.postings(S.corpus(spark, d)))


@query("index_stats",
    f"WITH {sql.INDEX} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT round(avg(word_count), 1) FROM counted) AS avg_doc_length, "
    f"(SELECT count(DISTINCT term) FROM posts) AS terms, (SELECT count(*) FROM posts) AS postings, (SELECT count(*) FROM pages) "
    f"AS pages"
)
def index_stats(spark, d):
    c, n = _base(spark, d)
    return index.index_stats(n, index.postings(c), S.table(spark, d, "pages"))


@query("term_postings", f"WITH {sql.INDEX} SELECT doc_id, field, tf FROM posts WHERE term = 'tion' AND field = 'body'")
def term_postings(spark, d):
    return index_of(spark, d).posts("tion").where("field = 'body'").select("doc_id", "field", "tf")


@query("document_postings", f"WITH {sql.INDEX} SELECT term, field, tf FROM posts WHERE doc_id = 17")
def document_postings(spark, d):
    return index_of(spark, d).posts_of_document(17).select("term", "field", "tf")


@query("reindex_delete", f"WITH {sql.INDEX} SELECT term, count(DISTINCT doc_id) AS df FROM posts WHERE doc_id % 7 <> 3 GROUP BY term")
def reindex_delete(spark, d):
    c = S.corpus(spark, d)
    return index.document_frequency(index.postings(index.delete(c, c.where("doc_id % 7 = 3"))))


# -- Boolean retrieval


def _boolean(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.evaluate(Q.parse(text), index_of(spark, sf_dir))

    return run


def _has(term: str, field: str | None = None) -> str:
    return f"SELECT doc_id FROM posts WHERE term = '{term}'" + (f" AND field = '{field}'" if field else "")


_ALL = "SELECT doc_id FROM docs"
_PHRASE = "SELECT a.doc_id FROM occ a JOIN occ b ON b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 1 WHERE a.term = '{0}' AND b.term = '{1}'"
for _name, _text, _sql in (
    ("bool_and", "tion ther", f"({_has('tion')} INTERSECT {_has('ther')})"),
    ("bool_or", "tion OR ther", f"({_has('tion')} UNION {_has('ther')})"),
    ("bool_not", "tion AND NOT ther", f"({_has('tion')} EXCEPT {_has('ther')})"),
    ("bool_only_not", "NOT tion", f"({_ALL} EXCEPT {_has('tion')})"),
    ("field_title", "title:tion", f"(SELECT DISTINCT doc_id FROM ({_has('tion', 'title')}))"),
    ("field_source", "source:src3", "(SELECT doc_id FROM docs WHERE lower(source) = 'src3')"),
    ("wildcard", "tio*", "(SELECT DISTINCT doc_id FROM posts WHERE starts_with(term, 'tio'))"),
    ("phrase", '"thou thor"', f"(SELECT DISTINCT doc_id FROM ({_PHRASE.format('thou', 'thor')}))"),
    (
        "nested_bool", '(tion OR ther) AND NOT (ing OR "thou thor") bl*',
        f"((({_has('tion')} UNION {_has('ther')}) EXCEPT ({_has('ing')} UNION {_PHRASE.format('thou', 'thor')})) INTERSECT SELECT doc_id FROM posts WHERE starts_with(term, 'bl'))"
    ),
):
    query(_name, f"WITH {sql.INDEX} SELECT DISTINCT doc_id FROM {_sql}")(_boolean(_text))


@query("bool_left_fold",
    f"WITH {sql.INDEX} SELECT DISTINCT doc_id FROM ((({_has('tion')} EXCEPT {_has('ther')}) INTERSECT {_has('ing')}) UNION (({_ALL} "
    f"EXCEPT {_has('ble')}) INTERSECT {_has('thon')}))"
)
def bool_left_fold(spark, d):
    return Q.left_fold("tion NOT ther ing OR NOT ble thon", index_of(spark, d))


# -- ranking

_RANK = f"WITH {sql.INDEX}, {sql.STATS}"


@query("bm25_top10", f"{_RANK}, {TOPICS_SQL}, {sql.BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 10")
def bm25_top10(spark, d):
    return rank.bm25(index_of(spark, d), topics(spark), 10)


@query("batch_bm25", f"{_RANK}, {sql.queries()}, {sql.BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 10")
def batch_bm25(spark, d):
    return rank.bm25(index_of(spark, d), S.query_set(spark, d), 10)


@query("bm25_explain",
    f"{_RANK}, {TOPICS_SQL}, {sql.BM25} SELECT query_id, doc_id, term, CAST(df AS BIGINT) AS df, CAST(tf AS BIGINT) AS tf, round(idf, "
    f"6) AS idf, round(tf_weight, 6) AS tf_weight, round(idf * tf_weight, 6) AS contribution FROM parts"
)
def bm25_explain(spark, d):
    p = rank.bm25_terms(index_of(spark, d), topics(spark))
    return p.select(
        "query_id", "doc_id", "term", "df", "tf", F.round("idf", 6).alias("idf"), F.round("tf_weight", 6).alias("tf_weight"),
        F.round("score", 6).alias("contribution")
    )


_TFIDF = """n AS (SELECT count(*) AS n FROM counted), tfs AS (SELECT term, doc_id, tf FROM posts WHERE field = 'body'),
w AS (SELECT term, ln(CAST((SELECT n FROM n) AS DOUBLE) / count(*)) AS idf FROM tfs GROUP BY term),
vec AS (SELECT t.doc_id, t.term, CAST(t.tf AS DOUBLE) / c.word_count * w.idf AS w FROM tfs t JOIN counted c ON c.doc_id = t.doc_id JOIN w ON w.term = t.term),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM vec GROUP BY doc_id),
ask AS (SELECT q.query_id, q.term, CAST(count(*) AS DOUBLE) / max(l.len) * max(w.idf) AS q FROM queries q JOIN (SELECT query_id, count(*) AS len FROM queries GROUP BY query_id) l ON l.query_id = q.query_id JOIN w ON w.term = q.term GROUP BY q.query_id, q.term),
askn AS (SELECT query_id, sqrt(sum(q * q)) AS qn FROM ask GROUP BY query_id),
dot AS (SELECT a.query_id, v.doc_id, sum(v.w * a.q) AS dot FROM vec v JOIN ask a ON a.term = v.term GROUP BY a.query_id, v.doc_id),
sc AS (SELECT d.query_id, d.doc_id, round(CASE WHEN nrm > 0 AND qn > 0 THEN dot / (nrm * qn) ELSE 0 END, 6) AS score FROM dot d JOIN nrm ON nrm.doc_id = d.doc_id JOIN askn ON askn.query_id = d.query_id),
tfidf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@query("tfidf_cosine",
    f"{_RANK}, {sql.queries()}, {_TFIDF} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM tfidf WHERE rank <= "
    f"10"
)
def tfidf_cosine(spark, d):
    return rank.tfidf(index_of(spark, d), S.query_set(spark, d), 10)


_TUNED = """cl AS (SELECT CAST(substr(query, 2) AS BIGINT) AS doc_id, count(*) AS clicks FROM clicks GROUP BY 1),
nq AS (SELECT query_id, count(*) AS n_terms FROM queries GROUP BY query_id),
g AS (SELECT p.query_id, p.doc_id, sum(idf * tf_weight) AS bm, sum(in_title) AS hits, max(created_at) AS created_at FROM parts p GROUP BY p.query_id, p.doc_id),
sig AS (SELECT g.query_id, g.doc_id, bm / CASE WHEN max(bm) OVER (PARTITION BY g.query_id) > 0 THEN max(bm) OVER (PARTITION BY g.query_id) ELSE 1 END AS a, CAST(hits AS DOUBLE) / n_terms AS b,
  exp(CAST(-0.01 AS DOUBLE) * greatest(0, date_diff('day', created_at, TIMESTAMP '2025-01-01'))) AS c, CAST(coalesce(cl.clicks, 0) AS DOUBLE) / (SELECT max(clicks) FROM cl) AS d
  FROM g JOIN nq ON nq.query_id = g.query_id LEFT JOIN cl ON cl.doc_id = g.doc_id),
tun AS (SELECT query_id, doc_id, round(a, 6) AS bm25_score, round(b, 6) AS title_score, round(c, 6) AS recency_score, round(d, 6) AS click_score,
  round(a + CAST(1.8 AS DOUBLE) * b + CAST(0.05 AS DOUBLE) * c + CAST(0.3 AS DOUBLE) * d, 6) AS score FROM sig),
tuned AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM tun)"""


def click_counts(spark, d):
    """Clicks on a document: those logged for the query of its number."""
    return S.clicks(S.log_events(spark, d)).groupBy(F.substring("query", 2, 10).cast("long").alias("doc_id")).agg(F.count("*").alias("clicks"))


@query("relevance_tuned", f"{_RANK}, {sql.queries()}, {sql.BM25}, {sql.EVENTS}, {_TUNED} SELECT * FROM tuned WHERE rank <= 10")
def relevance_tuned(spark, d):
    return rank.tuned(index_of(spark, d), S.query_set(spark, d), S.AS_OF, click_counts(spark, d))


@query("personal_boost", f"WITH {sql.EVENTS} SELECT DISTINCT session_id, query, CAST(0.5 AS DOUBLE) AS boost FROM clicks")
def personal_boost(spark, d):
    return rank.personal_boost(S.clicks(S.log_events(spark, d)))


@query("profile_history",
    f"WITH {sql.EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS n FROM "
    f"searches) SELECT session_id, string_agg(query, ',' ORDER BY n) AS history FROM r WHERE n <= 20 GROUP BY session_id"
)
def profile_history(spark, d):
    return rank.profile(S.searches(S.log_events(spark, d)), 20).select("session_id", F.array_join("history", ",").alias("history"))
