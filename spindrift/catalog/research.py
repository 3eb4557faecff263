"""Queries on answers, evidence and agents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agents, chunk, logs, rag
from ..plans import answers as plans
from ..sources import store
from ..sources import tables as S
from . import retrieval as R
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


def chunks(spark, d) -> DataFrame:
    """Of each of the ten best documents of every benchmark text, the chunk that holds the most of its terms (the first of
    equals), with the document's score over the best."""
    hits = store.kept(R.lexical(spark, d, 10))
    terms = S.query_set(spark, d).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    docs = S.corpus(spark, d).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = chunk.sliding(docs, "body").select("doc_id", "chunk_index", "text").join(docs.select("doc_id", "title"), "doc_id")
    held = F.size(F.array_intersect(F.array_distinct(T.terms(F.col("text"))), F.col("terms")))
    met = hits.join(terms, "query_id").join(parts, "doc_id").withColumn("held", held)
    first = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("held"), "chunk_index")
    best = met.withColumn("n", F.row_number().over(first)).where("n = 1")
    most = hits.groupBy("query_id").agg(F.max("score").alias("most"))
    score = F.round(F.col("score") / F.col("most"), 6).alias("score")
    return best.join(most, "query_id").select("query_id", F.col("rank").alias("place"), "doc_id", "chunk_index", "title", "text", score)


def context(spark, d) -> DataFrame:
    """The chunks within the budget, written once: answers, citations and scores read them from there."""
    return store.kept(rag.in_budget(chunks(spark, d)).drop("chunk_index"))


def answers(spark, d, ctx: DataFrame) -> DataFrame:
    """The stand-in's answer, with the query's own words behind it, which no source supports; written once."""
    said = rag.mock_answer(ctx)
    return store.kept(said.join(S.asked(spark, d), "query_id").select("query_id", F.concat_ws(" ", "answer", "query").alias("answer")))


def both(spark, d) -> tuple[DataFrame, DataFrame]:
    """Answers and their context."""
    ctx = context(spark, d)
    return answers(spark, d, ctx), ctx


def _sents(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace(trim({text}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


_EST = f"greatest(1, CAST(floor(len({sql.words('text')}) * CAST(1.3 AS DOUBLE)) AS INTEGER))"
_BIG = f"list_distinct(list_transform(range(1, greatest(len(ts), 1)), lambda i: ts[i] || ' ' || ts[i + 1]))"
_CTX = f"""WITH {R._LEX}, top AS (SELECT query_id, rank AS place, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM bm25 WHERE rank <= 10),
hw AS (SELECT doc_id, title, body, {sql.words('body')} AS w FROM docs WHERE doc_id IN (SELECT doc_id FROM top)),
hc AS (SELECT doc_id, title, w, len(w) AS n, unnest(range(0, len(w), 224)) AS s FROM hw WHERE len(w) > 256),
hk AS (SELECT *, least(s + 256, n) AS e FROM hc WHERE s = 0 OR s + 32 < n),
parts_ AS (SELECT doc_id, title, s, array_to_string(w[s + 1:e], ' ') AS text FROM hk WHERE e - s >= 10 UNION ALL SELECT doc_id, title, 0, trim(body) FROM hw WHERE len(w) <= 256),
pieces AS (SELECT doc_id, title, text, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i, list_distinct({sql.terms('text')}) AS ts FROM parts_),
qt AS (SELECT query_id, list_distinct(list(term)) AS ts FROM queries GROUP BY query_id),
held AS (SELECT t.query_id, t.place, t.doc_id, p.title, p.text, p.i, t.score, row_number() OVER (PARTITION BY t.query_id, t.doc_id ORDER BY len(list_intersect(p.ts, q.ts)) DESC, p.i) AS k FROM top t JOIN pieces p ON p.doc_id = t.doc_id JOIN qt q ON q.query_id = t.query_id),
ch AS (SELECT query_id, place, doc_id, i AS chunk_index, title, text, score FROM held WHERE k = 1),
tk AS (SELECT *, {_EST} AS tokens FROM ch),
cx0 AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS used FROM tk),
cx AS (SELECT * FROM cx0 WHERE used <= 2700),
an AS (SELECT x.query_id, concat_ws(' ', array_to_string({_sents('x.text')}[1:3], ' '), b.text) AS answer FROM cx x JOIN benchmark b ON b.item_id = x.query_id WHERE x.place = 1),
se AS (SELECT query_id, unnest(range(len(ss))) AS i, unnest(ss) AS sentence FROM (SELECT query_id, {_sents('answer')} AS ss FROM an)),
ct AS (SELECT s.query_id, s.i, s.sentence, c.place, {sql.jaccard(sql.token_set('s.sentence'), sql.token_set('c.text'))} AS v FROM se s JOIN cx c ON c.query_id = s.query_id),
cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, i ORDER BY v DESC, place) AS n FROM ct) WHERE n = 1),
ci AS (SELECT query_id, string_agg(CASE WHEN v >= CAST(0.08 AS DOUBLE) THEN rtrim(sentence) || ' [' || place || ']' ELSE sentence END, ' ' ORDER BY i) AS annotated, count(CASE WHEN v >= CAST(0.08 AS DOUBLE) THEN 1 END) AS n_cited FROM cb GROUP BY query_id),
sb AS (SELECT query_id, i, sentence, {_BIG} AS g FROM (SELECT *, {sql.raw('sentence')} AS ts FROM se WHERE len({sql.words('sentence')}) >= 4)),
cg AS (SELECT query_id, place, {_BIG} AS g FROM (SELECT *, {sql.raw('text')} AS ts FROM cx)),
gt AS (SELECT s.query_id, s.i, s.sentence, c.place, {sql.jaccard('s.g', 'c.g')} AS v FROM sb s JOIN cg c ON c.query_id = s.query_id),
cl AS (SELECT query_id, i, sentence, round(v, 4) AS support, place, v >= CAST(0.25 AS DOUBLE) AS supported FROM (SELECT *, row_number() OVER (PARTITION BY query_id, i ORDER BY v DESC, place) AS n FROM gt) WHERE n = 1),
gr0 AS (SELECT a.query_id, coalesce(floor((2 * sum(CAST(round(support * 10000) AS BIGINT)) + count(c.i)) / (2 * count(c.i))) / CAST(10000 AS DOUBLE), 0) AS grounding_score, round(coalesce(avg(CAST(supported AS INTEGER)), 0), 4) AS support_score, count(c.i) AS n_claims FROM an a LEFT JOIN cl c ON c.query_id = a.query_id GROUP BY a.query_id),
gr AS (SELECT *, CASE WHEN grounding_score >= 0.5 THEN 'low' WHEN grounding_score >= 0.25 THEN 'medium' ELSE 'high' END AS risk FROM gr0),
st AS (SELECT query_id, count(*) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(DISTINCT doc_id) AS n_sources, round(CAST(count(DISTINCT doc_id) AS DOUBLE) / count(*), 3) AS diversity, CAST(0 AS DOUBLE) AS redundancy FROM cx GROUP BY query_id)"""


@query("context_budget",
    f"{_CTX} SELECT query_id, CAST(place AS INTEGER) AS place, doc_id, score, CAST(tokens AS INTEGER) AS tokens, CAST(used AS "
    f"BIGINT) AS used FROM cx"
)
def context_budget(spark, d):
    return context(spark, d).select("query_id", "place", "doc_id", "score", "tokens", "used")


@query("context_stats", f"{_CTX} SELECT * FROM st")
def context_stats(spark, d):
    return rag.context_stats(context(spark, d))


@query("context_text",
    f"{_CTX} SELECT query_id, string_agg('[' || place || '] ' || title || ' (doc_id=' || doc_id || ')' || chr(10) || trim(text, "
    f"' '), chr(10) || chr(10) ORDER BY place) AS context FROM cx GROUP BY query_id"
)
def context_text(spark, d):
    return rag.assemble(context(spark, d))


@query("mmr")
def mmr(spark, d):
    """Greedy choice has no SQL equivalent; tests hold it against closed cases."""
    return rag.build_context(chunks(spark, d)).select("query_id", "place", "doc_id", F.round("score", 6).alias("score"), "tokens")


@query("prompt",
    f"{_CTX} SELECT x.query_id, 'Context:' || chr(10) || string_agg('[' || place || '] ' || title || ' (doc_id=' || doc_id || "
    f"')' || chr(10) || trim(x.text, ' '), chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || 'Question: ' || max(b.text) "
    f"|| chr(10) || 'Answer:' AS prompt FROM cx x JOIN benchmark b ON b.item_id = x.query_id GROUP BY x.query_id"
)
def prompt(spark, d):
    rows = rag.assemble(context(spark, d)).join(S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    return rows.select("query_id", rag.render("qa", F.col("context"), F.col("text")).alias("prompt"))


@query("mock_answer", f"{_CTX} SELECT query_id, array_to_string({_sents('text')}[1:3], ' ') AS answer FROM cx WHERE place = 1")
def mock_answer(spark, d):
    return rag.mock_answer(context(spark, d))


@query("citations", f"{_CTX} SELECT * FROM ci")
def citations(spark, d):
    return rag.cite(*both(spark, d))


@query("references", f"""{_CTX} SELECT query_id, string_agg('[' || place || '] ' || title || ' — "' || substr(text, 1, 100) || '"', chr(10) ORDER BY place) AS refs FROM cx GROUP BY query_id""")
def references(spark, d):
    return rag.references(context(spark, d))


@query("grounding_claims", f"{_CTX} SELECT query_id, CAST(i AS INTEGER) AS i, sentence, support, CAST(place AS INTEGER) AS place, supported FROM cl")
def grounding_claims(spark, d):
    return rag.claims(*both(spark, d))


@query("grounding", f"{_CTX} SELECT * FROM gr")
def grounding(spark, d):
    return rag.ground(*both(spark, d))


_CONF = rf"""cc AS (SELECT query_id, CAST(len(list_filter(ss, lambda s: regexp_matches(s, '\[\d+\]|\(Source:'))) AS DOUBLE) / len(ss) AS k FROM (SELECT query_id, {_sents('annotated')} AS ss FROM ci)),
rt AS (SELECT query_id, avg(least(1, greatest(0, score))) AS r FROM cx GROUP BY query_id),
cf AS (SELECT rt.query_id, round(r, 4) AS retrieval_confidence, round((diversity + (1 - redundancy)) / 2, 4) AS context_confidence, grounding_score AS grounding_confidence, round(k, 4) AS citation_confidence,
  round(least(1, greatest(0, CAST(0.25 AS DOUBLE) * r + CAST(0.15 AS DOUBLE) * ((diversity + (1 - redundancy)) / 2) + CAST(0.4 AS DOUBLE) * grounding_score + CAST(0.2 AS DOUBLE) * k)), 4) AS overall
  FROM rt JOIN st ON st.query_id = rt.query_id JOIN gr ON gr.query_id = rt.query_id JOIN cc ON cc.query_id = rt.query_id)"""


@query("confidence",
    f"{_CTX}, {_CONF} SELECT *, CASE WHEN overall >= 0.65 THEN 'high' WHEN overall >= 0.4 THEN 'medium' ELSE 'low' END AS tier "
    f"FROM cf"
)
def confidence(spark, d):
    a, c = both(spark, d)
    return rag.confidence(c, rag.context_stats(c), rag.ground(a, c), rag.cite(a, c))


def _share(x: str, y: str) -> str:
    return f"round(CASE WHEN len({x}) > 0 THEN CAST(len(list_intersect({x}, {y})) AS DOUBLE) / len({x}) ELSE 0 END, 4)"


_RAGM = rf"""tx AS (SELECT query_id, list_distinct(flatten(list({sql.raw("concat_ws(' ', title, text)")}))) AS ctx, list({sql.token_set('text')}) AS sets, max(place) AS sources FROM cx GROUP BY query_id),
cs AS (SELECT i.query_id, b.text AS query, i.annotated AS answer, g.support_score, {sql.token_set('i.annotated')} AS a, {sql.token_set('b.text')} AS q, ctx, sets, sources,
  list_transform(regexp_extract_all(i.annotated, '\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER)) AS tags, len({sql.words('b.text')}) AS nq, len({sql.words('i.annotated')}) AS na
  FROM ci i JOIN benchmark b ON b.item_id = i.query_id JOIN gr g ON g.query_id = i.query_id JOIN tx ON tx.query_id = i.query_id),
rm0 AS (SELECT query_id, {_share('a', 'ctx')} AS faithfulness, support_score AS groundedness, {_share('q', 'a')} AS answer_relevance,
  round(CAST(len(list_filter(sets, lambda s: CAST(len(list_intersect(s, a)) AS DOUBLE) / greatest(len(a), 1) >= CAST(0.05 AS DOUBLE))) AS DOUBLE) / len(sets), 4) AS context_precision, {_share('q', 'ctx')} AS context_recall,
  round(CASE WHEN len(tags) > 0 THEN CAST(len(list_filter(tags, lambda x: x >= 1 AND x <= sources)) AS DOUBLE) / len(tags) ELSE 0.5 END, 4) AS citation_accuracy, round(least(1, CAST(na AS DOUBLE) / (nq * 3)), 4) AS response_completeness FROM cs),
rm AS (SELECT *, floor(({' + '.join(f'{round(100 * w)} * CAST(round({m} * 10000) AS BIGINT)' for m, w in rag.METRICS.items())} + 50) / 100) / CAST(10000 AS DOUBLE) AS overall_score FROM rm0)"""


def _cases(spark, d) -> tuple[DataFrame, DataFrame]:
    a, c = both(spark, d)
    q = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("ground_truth"))
    cited = rag.cite(a, c).select("query_id", F.col("annotated").alias("answer"))
    return q.join(cited, "query_id").join(rag.ground(a, c).select("query_id", "support_score"), "query_id"), c


@query("rag_metrics", f"{_CTX}, {_RAGM} SELECT * FROM rm")
def rag_metrics(spark, d):
    return rag.rag_metrics(*_cases(spark, d))


@query("rag_report",
    f"{_CTX}, {_RAGM} SELECT count(*) AS total_cases, {', '.join(f'round(avg({m}), 4) AS {m}' for m in [*rag.METRICS, 'overall_score'])} "
    f"FROM rm"
)
def rag_report(spark, d):
    return rag.rag_report(rag.rag_metrics(*_cases(spark, d)))


@query("history_window",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, "
    "'### Conversation History' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || "
    "text, chr(10) ORDER BY turn) || chr(10) || chr(10) AS history FROM r WHERE n <= 4 GROUP BY conv_id"
)
def history_window(spark, d):
    return rag.history(S.table(spark, d, "conversations"), 4)


@query("memory_summary",
    "WITH r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS "
    "i FROM conversations), o AS (SELECT * FROM r WHERE n >= 6 AND i <= n - 3), u AS (SELECT conv_id, string_agg(chr(10) || ' "
    " User asked: ' || substr(text, 1, 100), '' ORDER BY turn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER "
    "BY turn) AS k FROM o WHERE role = 'user') WHERE k <= 3 GROUP BY conv_id) SELECT conv_id, turn, role, text FROM r WHERE n "
    "< 6 OR i > n - 3 UNION ALL SELECT o.conv_id, min(turn) - 1, 'system', '[Earlier in this conversation (' || count(*) || ' "
    "messages)]' || coalesce(max(u.t), '') FROM o LEFT JOIN u ON u.conv_id = o.conv_id GROUP BY o.conv_id"
)
def memory_summary(spark, d):
    return rag.summarise(S.table(spark, d, "conversations"), 3, 6)


# -- evidence: every benchmark query is a session, its chunks the evidence

_EV = f"{_CTX}, ev AS (SELECT query_id AS session_id, 't' || (place % 3) AS topic, place, doc_id, 'doc_' || doc_id || '_' || chunk_index AS chunk_id, title, text AS content, score FROM ch)"


def evidence(spark, d) -> DataFrame:
    name = F.concat_ws("_", F.lit("doc"), "doc_id", "chunk_index").alias("chunk_id")
    topic = F.concat(F.lit("t"), (F.col("place") % 3).cast("string")).alias("topic")
    return store.kept(chunks(spark, d).select(
        F.col("query_id").alias("session_id"), topic, "place", "doc_id", name, "title", F.col("text").alias("content"), "score"
    ))


@query("retrieval_quality",
    f"{_EV} SELECT session_id, round(CAST(0.3 AS DOUBLE) * least(1, CAST(count(*) AS DOUBLE) / 5) + CAST(0.4 AS DOUBLE) * least(1, "
    f"avg(score)) + CAST(0.3 AS DOUBLE) * (CAST(count(DISTINCT title) AS DOUBLE) / count(*)), 4) AS quality, count(*) AS evidence_count "
    f"FROM ev GROUP BY session_id"
)
def retrieval_quality(spark, d):
    return agents.retrieval_quality(evidence(spark, d), "session_id")


_CRITIC = f"""asked AS (SELECT item_id AS session_id, unnest(['t0', 't1', 't2', 't3']) AS topic FROM benchmark),
fd AS (SELECT a.session_id, a.topic, count(e.doc_id) AS n FROM asked a LEFT JOIN ev e ON e.session_id = a.session_id AND e.topic = a.topic GROUP BY a.session_id, a.topic),
cv AS (SELECT session_id, round(avg(CASE WHEN n > 0 THEN 1 ELSE 0 END), 4) AS coverage, round(avg(least(1, CAST(n AS DOUBLE) / 3)), 4) AS completeness, sum(n) AS items FROM fd GROUP BY session_id),
gd AS (SELECT session_id, round(avg(CASE WHEN score >= 0.3 THEN 1 ELSE 0 END), 4) AS quality FROM ev GROUP BY session_id),
ww AS (SELECT *, list_distinct({sql.words('lower(content)')}) AS w FROM ev),
pr AS (SELECT a.session_id, round(1 - CAST(sum(CASE WHEN {sql.jaccard('a.w', 'b.w')} < 0.05 AND a.title = b.title THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 4) AS consistency FROM ww a JOIN ww b ON b.session_id = a.session_id AND b.place BETWEEN a.place + 1 AND a.place + 4 GROUP BY a.session_id),
cr AS (SELECT cv.session_id, coverage, coalesce(quality, 0) AS quality, coalesce(consistency, 1) AS consistency, completeness, items FROM cv LEFT JOIN gd ON gd.session_id = cv.session_id LEFT JOIN pr ON pr.session_id = cv.session_id)"""


@query("critic_scores",
    f"{_EV}, {_CRITIC} SELECT session_id, coverage, quality, consistency, completeness, CASE WHEN items = 0 THEN 0 ELSE round(CAST(0.3 "
    f"AS DOUBLE) * coverage + CAST(0.3 AS DOUBLE) * quality + CAST(0.2 AS DOUBLE) * consistency + CAST(0.2 AS DOUBLE) * completeness, "
    f"4) END AS overall, array_to_string(list_filter([CASE WHEN items = 0 THEN 'no_evidence' END, CASE WHEN coverage < 0.5 THEN "
    f"'low_coverage' END, CASE WHEN quality < 0.5 THEN 'low_quality' END, CASE WHEN consistency < 0.8 THEN 'contradictions' END, "
    f"CASE WHEN completeness < 0.5 THEN 'incomplete' END, CASE WHEN items < 3 THEN 'insufficient_evidence' END], lambda x: x IS "
    f"NOT NULL), ',') AS issues FROM cr"
)
def critic_scores(spark, d):
    asked = S.table(spark, d, "benchmark").select(
        F.col("item_id").alias("session_id"), F.explode(F.array(*[F.lit(f"t{i}") for i in range(4)])).alias("topic")
    )
    return agents.critique(evidence(spark, d), asked).withColumn("issues", F.array_join("issues", ","))


_CITED = f"""ca AS (SELECT query_id AS session_id, annotated || ' See [99].' AS answer FROM ci),
cs2 AS (SELECT session_id, unnest(range(len(ss))) AS i, unnest(ss) AS sentence FROM (SELECT session_id, {_sents('answer')} AS ss FROM ca)),
tg AS (SELECT session_id, i, sentence, CAST(unnest(regexp_extract_all(sentence, '\\[(\\d+)\\]', 1)) AS INTEGER) AS tag FROM cs2),
ck AS (SELECT t.session_id, t.i, substr(t.sentence, 1, 200) AS sentence, t.tag, CASE WHEN e.content IS NULL THEN 'missing_source' WHEN {sql.jaccard(sql.token_set('t.sentence'), sql.token_set('e.content'))} >= CAST(0.08 AS DOUBLE) THEN 'supported' ELSE 'unsupported' END AS status,
  CASE WHEN e.content IS NULL THEN 0 ELSE round({sql.jaccard(sql.token_set('t.sentence'), sql.token_set('e.content'))}, 4) END AS overlap FROM tg t LEFT JOIN ev e ON e.session_id = t.session_id AND e.place = t.tag)"""


def _cited(spark, d) -> DataFrame:
    return rag.cite(*both(spark, d)).select(F.col("query_id").alias("session_id"), F.concat("annotated", F.lit(" See [99].")).alias("answer"))


@query("citation_validation", f"{_EV}, {_CITED} SELECT session_id, CAST(i AS INTEGER) AS i, sentence, tag, status, overlap FROM ck")
def citation_validation(spark, d):
    return agents.check_citations(_cited(spark, d), evidence(spark, d))


@query("citation_report",
    f"{_EV}, {_CITED} SELECT session_id, count(*) AS total, count(CASE WHEN status = 'supported' THEN 1 END) AS supported, count(CASE "
    f"WHEN status <> 'supported' THEN 1 END) AS unsupported, round(CAST(count(CASE WHEN status = 'supported' THEN 1 END) AS DOUBLE) "
    f"/ count(*), 4) AS accuracy FROM ck GROUP BY session_id"
)
def citation_report(spark, d):
    a = _cited(spark, d)
    return agents.citation_report(agents.check_citations(a, evidence(spark, d)), a)


@query("evidence_validate")
def evidence_validate(spark, d):
    """Each verdict depends on the ones before; tests hold it against closed cases."""
    return agents.validate(evidence(spark, d)).select("session_id", "place", "doc_id", "verdict")


@query("evidence_memory",
    f"{_EV}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id, doc_id, chunk_id ORDER BY score DESC, place) AS n FROM "
    f"ev), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, doc_id, chunk_id) AS m FROM b WHERE "
    f"n = 1) SELECT session_id, doc_id, chunk_id, score FROM k WHERE m <= 4"
)
def evidence_memory(spark, d):
    return agents.remember(evidence(spark, d), 4).select("session_id", "doc_id", "chunk_id", "score")


@query("evidence_graph",
    f"{_EV} SELECT doc_id || ':' || session_id AS evidence_id, score, CAST(sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS supports, CAST(sum(CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS contradicts, CAST(sum(CASE WHEN k % 3 = 2 THEN "
    f"1 ELSE 0 END) AS BIGINT) AS extends FROM (SELECT e.*, f.place + e.place AS k FROM ev e LEFT JOIN ev f ON f.session_id = "
    f"e.session_id AND f.place < e.place) GROUP BY ALL"
)
def evidence_graph(spark, d):
    e = evidence(spark, d).withColumn("evidence_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("session_id").cast("string")))
    f = e.select("session_id", F.col("place").alias("p2"), F.col("evidence_id").alias("src"))
    kinds = F.element_at(F.array(F.lit("supports"), F.lit("contradicts"), F.lit("extends")), F.pmod(F.col("place") + F.col("p2"), F.lit(3)) + 1)
    edges = e.join(f, "session_id").where("p2 < place").select("src", F.col("evidence_id").alias("dst"), kinds.alias("kind"))
    return agents.evidence_graph(e.select("evidence_id", "score"), edges)


_CASE = "rc AS (SELECT item_id AS case_id, item_id % 5 AS completed_steps, 5 AS total_steps, item_id % 4 AS topic_count, least(item_id % 4, 2) AS topics_covered, item_id % 9 AS evidence_count, CAST(item_id % 11 AS DOUBLE) / 10 AS citation_accuracy, CAST(item_id % 7 AS DOUBLE) / 7 AS grounding_score, CASE WHEN item_id % 6 = 0 THEN '' ELSE '## A [1] ' || text END AS report_text FROM benchmark)"


@query("research_metrics", f"""WITH {_CASE}, p AS (SELECT *, CAST(completed_steps AS DOUBLE) / 5 AS t, CASE WHEN topic_count > 0 THEN least(1, CAST(evidence_count AS DOUBLE) / topic_count / 3) ELSE 0 END AS f, CASE WHEN topic_count > 0 THEN CAST(topics_covered AS DOUBLE) / topic_count ELSE 0 END AS e,
  greatest(0, 1 - grounding_score) AS l, CASE WHEN report_text = '' THEN 0 ELSE round(CAST(0.5 AS DOUBLE) * least(1, CAST(len({sql.words('report_text')}) AS DOUBLE) / 200) + CAST(0.5 AS DOUBLE), 4) END AS q FROM rc)
SELECT case_id, round(t, 4) AS task_completion, round(f, 4) AS research_completeness, round(citation_accuracy, 4) AS citation_accuracy, round(e, 4) AS evidence_coverage, round(grounding_score, 4) AS grounding_quality, round(l, 4) AS hallucination_rate, round(q, 4) AS report_quality,
  round(CAST(0.2 AS DOUBLE) * t + CAST(0.2 AS DOUBLE) * f + CAST(0.15 AS DOUBLE) * citation_accuracy + CAST(0.15 AS DOUBLE) * e + CAST(0.15 AS DOUBLE) * grounding_score + CAST(0.05 AS DOUBLE) * (1 - l) + CAST(0.1 AS DOUBLE) * q, 4) AS overall_score FROM p""")
def research_metrics(spark, d):
    i = F.col("item_id")
    rows = S.table(spark, d, "benchmark").select(
        i.alias("case_id"), (i % 5).alias("completed_steps"), F.lit(5).alias("total_steps"), (i % 4).alias("topic_count"),
        F.least(i % 4, F.lit(2)).alias("topics_covered"), (i % 9).alias("evidence_count"), ((i % 11) / 10).alias("citation_accuracy"),
        ((i % 7) / 7).alias("grounding_score"), F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("## A [1] "), "text")).alias("report_text")
    )
    return agents.research_metrics(rows)


_GOALS = ("compare rust, go and zig", "What is A? How does B work?", "why does the cache miss", "spark")


@query("plan_steps",
    "SELECT * FROM (VALUES (0, 'comparison', 6, 'retrieve_0,retrieve_1,retrieve_2,critic_0,citval_0,synthesis_0'), (1, 'multi_part', "
    "5, 'retrieve_0,retrieve_1,critic_0,citval_0,synthesis_0'), (2, 'investigation', 4, 'retrieve_0,critic_0,citval_0,synthesis_0'), "
    "(3, 'simple', 4, 'retrieve_0,critic_0,citval_0,synthesis_0')) AS v(goal_id, strategy, steps, dag_order)"
)
def plan_steps(spark, d):
    rows = []
    for i, g in enumerate(_GOALS):
        strategy, _, steps = agents.plan(g)
        rows.append((i, strategy, len(steps), ",".join(agents.order(steps))))
    return spark.createDataFrame(rows, "goal_id int, strategy string, steps int, dag_order string")


@query("workflow_transitions",
    "WITH l AS (SELECT user_id AS execution_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN "
    "'running' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state FROM events), m AS (SELECT "
    "*, lag(state) OVER (PARTITION BY execution_id ORDER BY seq) AS before FROM l) SELECT execution_id, seq, before, state FROM "
    "m WHERE before IS NOT NULL AND NOT ((before = 'created' AND state = 'running') OR (before = 'running' AND state IN ('completed', "
    "'failed', 'paused')) OR (before = 'paused' AND state = 'running'))"
)
def workflow_transitions(spark, d):
    e = S.table(spark, d, "events")
    state = F.create_map(*[F.lit(x) for x in ("signup", "created", "view", "running", "click", "paused", "purchase", "completed", "error", "failed")])
    return agents.invalid_transitions(e.select(
        F.col("user_id").alias("execution_id"), F.col("event_id").alias("seq"), state[F.col("event_type")].alias("state")
    ))


@query("task_queue",
    "SELECT event_id AS task_id, user_id % 4 AS priority, CAST(row_number() OVER (ORDER BY user_id % 4 DESC, ts, event_id) AS "
    "INTEGER) AS place FROM events ORDER BY place LIMIT 50"
)
def task_queue(spark, d):
    e = S.log_events(spark, d).select(
        F.col("event_id").alias("task_id"), (F.col("session_id") % 4).alias("priority"), F.col("ts").alias("created_at")
    )
    return agents.schedule(e, 50).select("task_id", "priority", "place")


@query("schedules_due",
    "SELECT event_id AS schedule_id, CASE WHEN event_type <> 'click' THEN TIMESTAMP '2024-01-15' + INTERVAL 600 SECONDS END AS "
    "next_run, event_type <> 'click' AS enabled FROM events WHERE event_type <> 'error' AND ts <= TIMESTAMP '2024-01-15'"
)
def schedules_due(spark, d):
    e = S.log_events(spark, d).select(
        F.col("event_id").alias("schedule_id"), F.col("ts").alias("next_run"), F.when(F.col("event_type") != "click", 600).alias("interval_s"),
        (F.col("event_type") != "error").alias("enabled")
    )
    return agents.due(e, "2024-01-15 00:00:00")


# -- whole answers, and reads on grounding, confidence, citations and evidence


@query("rag_answers",
    f"{_CTX}, {_CONF} SELECT b.item_id AS query_id, 'stand-in' AS model, i.annotated AS answer, st.n_chunks, gr.grounding_score, "
    f"gr.risk, cf.overall AS confidence FROM benchmark b LEFT JOIN ci i ON i.query_id = b.item_id LEFT JOIN st ON st.query_id "
    f"= b.item_id LEFT JOIN gr ON gr.query_id = b.item_id LEFT JOIN cf ON cf.query_id = b.item_id".replace(
        "concat_ws(' ', array_to_string(" + _sents("x.text") + "[1:3], ' '), b.text)", "array_to_string(" + _sents("x.text") + "[1:3], ' ')"
    ))
def rag_answers(spark, d):
    """The whole chain by one call. Chunks are taken in the order of their scores here: no two are alike enough to be dropped
    (same=2), and relevance alone decides (mmr=False)."""
    got = plans.ask(S.asked(spark, d), chunks(spark, d), plans.stand_in(), same=2.0, mmr=False, least=-1.0)
    return got.select("query_id", "model", "answer", "n_chunks", "grounding_score", "risk", "confidence")


@query("grounding_stats",
    f"{_CTX} SELECT count(*) AS n, round(avg(grounding_score), 4) AS avg_score, count(CASE WHEN risk = 'high' THEN 1 END) AS high_risk "
    f"FROM gr"
)
def grounding_stats(spark, d):
    return rag.ground(*both(spark, d)).agg(
        F.count("*").alias("n"), F.round(F.avg("grounding_score"), 4).alias("avg_score"),
        F.count(F.when(F.col("risk") == "high", 1)).alias("high_risk")
    )


@query("confidence_stats",
    f"{_CTX}, {_CONF} SELECT count(*) AS n, round(avg(overall), 4) AS avg_confidence, count(CASE WHEN overall >= 0.65 THEN 1 END) "
    f"AS high, count(CASE WHEN overall < 0.4 THEN 1 END) AS low FROM cf"
)
def confidence_stats(spark, d):
    tier = lambda t: F.count(F.when(F.col("tier") == t, 1))
    return confidence(spark, d).agg(
        F.count("*").alias("n"), F.round(F.avg("overall"), 4).alias("avg_confidence"), tier("high").alias("high"), tier("low").alias("low")
    )


@query("session_citations", f"{_EV}, {_CITED} SELECT CAST(i AS INTEGER) AS i, tag, status FROM ck WHERE session_id = 3 ORDER BY i, tag")
def session_citations(spark, d):
    return citation_validation(spark, d).where("session_id = 3").orderBy("i", "tag").select("i", "tag", "status")


@query("session_evidence", f"{_EV} SELECT doc_id, chunk_id, score FROM ev WHERE session_id = 3 ORDER BY score DESC, doc_id LIMIT 5")
def session_evidence(spark, d):
    return evidence(spark, d).where("session_id = 3").orderBy(F.desc("score"), "doc_id").limit(5).select("doc_id", "chunk_id", "score")


@query("evidence_extract", f"""{_EV}, sx AS (SELECT session_id, place, doc_id, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM (SELECT session_id, place, doc_id, {_sents('content')} AS ss FROM ev)),
sy AS (SELECT x.*, len(list_intersect({sql.token_set('x.s')}, {sql.token_set('b.text')})) AS n FROM sx x JOIN benchmark b ON b.item_id = x.session_id),
sz AS (SELECT *, row_number() OVER (PARTITION BY session_id, place ORDER BY n DESC, i) AS k FROM sy WHERE n >= 1)
SELECT session_id AS query_id, CAST(place AS INTEGER) AS place, doc_id, string_agg(s, ' ' ORDER BY i) AS evidence FROM sz WHERE k <= 3 GROUP BY session_id, place, doc_id""")
def evidence_extract(spark, d):
    return agents.extract(chunks(spark, d), S.asked(spark, d)).select("query_id", "place", "doc_id", "evidence")


@query("synthesis", rf"""{_EV}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id, topic ORDER BY score DESC, place) AS n FROM ev),
k AS (SELECT * FROM b WHERE n <= 3),
t AS (SELECT session_id, topic, '## ' || topic || chr(10) || string_agg('- ' || substr(regexp_replace(trim(content, ' '), '\s+', ' ', 'g'), 1, 200) || ' [' || place || ']', chr(10) ORDER BY n) AS s, count(*) AS c FROM k GROUP BY session_id, topic),
y AS (SELECT session_id, string_agg(s, chr(10) || chr(10) ORDER BY topic) AS body, count(*) AS n_topics, CAST(sum(c) AS BIGINT) AS n_cited FROM t GROUP BY session_id),
r AS (SELECT session_id, string_agg('[' || place || '] ' || title, chr(10) ORDER BY place) AS sources FROM k GROUP BY session_id)
SELECT y.session_id, body || chr(10) || chr(10) || '## Sources' || chr(10) || sources AS report, n_topics, n_cited FROM y JOIN r ON r.session_id = y.session_id""")
def synthesis(spark, d):
    return agents.synthesise(evidence(spark, d))


@query("research_summary", f"""WITH {_CASE} SELECT count(*) AS n, round(avg(CAST(completed_steps AS DOUBLE) / 5), 4) AS avg_completion, count(CASE WHEN citation_accuracy >= 0.5 THEN 1 END) AS cited_well, count(CASE WHEN grounding_score < 0.3 THEN 1 END) AS ungrounded FROM rc""")
def research_summary(spark, d):
    return agents.research_summary(research_metrics(spark, d))


# -- runs of workflows, queues and memories, on the event table

_STEPS = "steps AS (SELECT user_id AS execution_id, event_type AS step_id, event_id AS seq, ts, CASE WHEN value < 20 THEN 'failed' ELSE 'done' END AS state, event_id % 3 + 1 AS attempts FROM events)"


def _steps(spark, d) -> DataFrame:
    e = S.log_events(spark, d)
    state = F.when(F.col("value") < 20, "failed").otherwise("done")
    return e.select(
        F.col("session_id").alias("execution_id"), F.col("event_type").alias("step_id"), F.col("event_id").alias("seq"), "ts", state.alias("state"),
        (F.col("event_id") % 3 + 1).alias("attempts")
    )


@query("workflow_executions",
    f"WITH {_STEPS} SELECT execution_id, count(DISTINCT step_id) AS steps, count(CASE WHEN state = 'done' THEN 1 END) AS done, "
    f"count(CASE WHEN state = 'failed' THEN 1 END) AS failed, CAST(sum(attempts - 1) AS BIGINT) AS retries, round(epoch(max(ts)) "
    f"- epoch(min(ts)), 3) AS seconds FROM steps GROUP BY execution_id"
)
def workflow_executions(spark, d):
    took = F.round(F.col("ended").cast("double") - F.col("started").cast("double"), 3)
    return agents.executions(_steps(spark, d)).select("execution_id", "steps", "done", "failed", "retries", took.alias("seconds"))


@query("workflow_checkpoints",
    f"WITH {_STEPS} SELECT execution_id, step_id, state FROM (SELECT *, row_number() OVER (PARTITION BY execution_id, step_id "
    f"ORDER BY ts DESC, seq DESC) AS n FROM steps) WHERE n = 1"
)
def workflow_checkpoints(spark, d):
    return agents.checkpoints(_steps(spark, d))


@query("workflow_runs", f"WITH {_STEPS} SELECT execution_id, step_id, seq FROM steps WHERE state = 'failed' ORDER BY ts DESC, seq LIMIT 20")
def workflow_runs(spark, d):
    return logs.newest(_steps(spark, d), "ts", 20, "seq", where={"state": "failed"}).select("execution_id", "step_id", "seq")


@query("queue_admitted",
    "SELECT event_id AS task_id, event_type AS queue, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 100 "
    "AS admitted FROM events"
)
def queue_admitted(spark, d):
    e = S.log_events(spark, d).select(F.col("event_id").alias("task_id"), F.col("event_type").alias("queue"), F.col("ts").alias("created_at"))
    return agents.admitted(e, 100).select("task_id", "queue", "admitted")


@query("task_strategies", " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, * FROM (SELECT event_id AS task_id, CAST(row_number() OVER (ORDER BY {by}, event_id) AS INTEGER) "
    f"AS place FROM events WHERE event_type <> 'error' ORDER BY place LIMIT 20)"
for s, by in (("priority", "user_id % 4 DESC, ts"), ("fifo", "ts"), ("deadline", "event_id % 97, user_id % 4 DESC"), ("shortest", "value, ts"))))
def task_strategies(spark, d):
    e = S.log_events(spark, d)
    tasks = e.select(
        F.col("event_id").alias("task_id"), (F.col("session_id") % 4).alias("priority"), F.col("ts").alias("created_at"),
        (F.col("event_id") % 97).alias("deadline"), F.col("value").alias("estimate"), (F.col("event_type") == "error").alias("cancelled")
    )
    named = [agents.schedule(tasks, 20, s).select(F.lit(s).alias("strategy"), "task_id", "place") for s in agents.STRATEGIES]
    return reduce(DataFrame.unionByName, named)


@query("session_memory",
    "SELECT user_id AS session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS "
    "n FROM events) WHERE n <= 5"
)
def session_memory(spark, d):
    items = S.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"))
    return agents.bounded(items, "session_id", 5).select("session_id", F.col("seq").alias("event_id"))


@query("support_snippets")
def support_snippets(spark, d):
    """The window of a chunk that supports a claim best; found by a scan of the words, which tests hold against closed cases."""
    a, c = both(spark, d)
    held = rag.claims(a, c).where("supported").join(c.select("query_id", "place", "text"), ["query_id", "place"])
    return held.select("query_id", "i", "place", rag.support(F.col("sentence"), F.col("text")).alias("snippet"))
