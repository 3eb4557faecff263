"""Common table expressions of the DuckDB equivalents: the supplied tables read as the engine's entities."""

from __future__ import annotations

from ..functions.text import MAX_LENGTH, MIN_LENGTH, STOP_WORDS

STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
TOKEN = r"[\p{L}\p{N}]+"


def raw(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}')"


def is_term(t: str) -> str:
    return f"(length({t}) BETWEEN {MIN_LENGTH} AND {MAX_LENGTH} AND regexp_matches({t}, '[a-zA-Z]') AND {t} NOT IN {STOP})"


def terms(text: str) -> str:
    return f"list_filter({raw(text)}, lambda t: {is_term('t')})"


def words(text: str) -> str:
    return rf"list_filter(string_split_regex(trim({text}), '\s+'), lambda w: w <> '')"


def jaccard(a: str, b: str) -> str:
    """Of two lists of distinct values."""
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}) ELSE CAST(0 AS DOUBLE) END)"


def token_set(text: str) -> str:
    return f"list_distinct({raw(text)})"


DOCS = "docs AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS body, source, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS created_at FROM documents)"
COUNTED = f"counted AS (SELECT *, len({terms('body')}) AS word_count FROM docs)"
OCC = f"""occ AS (SELECT doc_id, field, pos, term FROM (
  SELECT doc_id, field, unnest(range(len(ts))) AS pos, unnest(ts) AS term FROM (
    SELECT doc_id, 'title' AS field, {raw('title')} AS ts FROM docs UNION ALL SELECT doc_id, 'body', {raw('body')} FROM docs)) WHERE {is_term('term')})"""
POSTS = "posts AS (SELECT term, doc_id, field, count(*) AS tf FROM occ GROUP BY ALL)"
INDEX = f"{DOCS}, {COUNTED}, {OCC}, {POSTS}"
STATS = "stats AS (SELECT count(*) AS n, avg(word_count) AS avgdl FROM counted)"

EVENTS = """ev AS (SELECT event_id, ts, user_id AS session_id, event_type, value, 'q' || json_extract_string(props, '$.k') AS query, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS position FROM events),
searches AS (SELECT event_id, ts, session_id, query, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS results_count, value AS latency_ms FROM ev WHERE event_type IN ('view', 'error')),
clicks AS (SELECT event_id, ts, session_id, query, position FROM ev WHERE event_type = 'click')"""
COSTS = "costs AS (SELECT event_id, ts, event_type AS category, 't' || (user_id % 5) AS tenant_id, 'p' || (user_id % 3) AS provider, value / 1000 AS cost_usd FROM events)"


def queries() -> str:
    """query_id, place, term: all terms of each benchmark text."""
    return f"queries AS (SELECT query_id, unnest(range(len(ts))) AS place, unnest(ts) AS term FROM (SELECT item_id AS query_id, {terms('text')} AS ts FROM benchmark))"


#: Needs INDEX, STATS and queries(): every query term's weight in each document.
BM25 = """dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM occ GROUP BY term),
found AS (SELECT term, doc_id, sum(CASE WHEN field = 'body' THEN 1 ELSE 0 END) AS tf, max(CASE WHEN field = 'title' THEN 1 ELSE 0 END) AS in_title FROM occ GROUP BY term, doc_id),
parts AS (SELECT q.query_id, f.doc_id, f.term, d.df, f.tf, f.in_title, c.created_at,
    ln((CAST(s.n AS DOUBLE) - d.df + CAST(0.5 AS DOUBLE)) / (d.df + CAST(0.5 AS DOUBLE)) + 1) AS idf,
    CAST(f.tf AS DOUBLE) * CAST(2.5 AS DOUBLE) / (f.tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * greatest(c.word_count, 1) / s.avgdl)) AS tf_weight
  FROM (SELECT DISTINCT query_id, term FROM queries) q JOIN found f ON f.term = q.term JOIN dfs d ON d.term = q.term JOIN counted c ON c.doc_id = f.doc_id CROSS JOIN stats s),
bm AS (SELECT query_id, doc_id, round(sum(idf * tf_weight), 6) AS score FROM parts GROUP BY query_id, doc_id),
bm25 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""
