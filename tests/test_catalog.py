"""Queries against their DuckDB equivalents on the smallest tables; the driver compares all of them on larger ones."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "tokenize_counts", "postings_tf", "doc_freq", "index_stats", "nested_bool", "phrase", "bm25_top10", "tfidf_cosine", "relevance_tuned", "vector_topk", "semantic_best_chunk", "hybrid", "pipeline4",
    "ltr_features", "eval_per_query", "spell_correct", "synonym_expand", "intent", "chunk_sliding", "citations", "grounding", "confidence", "critic_scores", "cost_summary", "latency_percentiles",
    "session_ttl", "stream_search_volume", "robots", "url_normalize",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(cell(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def same_as_sql(spark, folder, name, rows):
    """Whether a query returns what its SQL does, over other pages."""
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(folder)), c.sql(entry.oracle_sql()[name])
    assert got.columns == want.columns
    assert plain(got.collect()) == plain(want.fetchall())


@pytest.mark.parametrize("urls", [
    {},  # each URL once
    {6: "http://e.com/9", 9: "http://e.com/9", 12: "http://e.com/15", 15: "http://e.com/15", 8: "http://e.com/14"},  # done and pending; found twice
    {5: None, 8: None},  # unknown ones found
    {9: None},  # held
    {13: None},  # seen
])
def test_frontier_with_urls_of_several_pages_or_none(spark, tmp_path, urls):
    same_as_sql(spark, tmp_path, "frontier_enqueue", [(i, urls.get(i, f"http://e.com/{i}"), "") for i in range(420)])


def test_frontier_of_one_page_without_a_url(spark, tmp_path):
    same_as_sql(spark, tmp_path, "frontier_enqueue", [(5, None, "")])


def test_titles_as_written(spark, tmp_path):
    inner = [
        "a", "a &quot;b&quot; &lt;c&gt; &#233; &eacute;", "a&amp;amp;b &AMP; &amp", "a &am", "a&", "", "  ", " a  b ", "\ta\n", "\n a \n", "\u00a0\u2003a\u3000", "\u200ba\u2028", "é\U0001f600&amp;", "<b>a</b>", "<title>a",
        "a<!-- b -->", "a\r\nb", "\x00a\x1f",
    ]
    htmls = [f"<head><title>{x}</title></head><h1>h</h1>" for x in inner] + [
        None, "", "<h1>h</h1>", "<title>a", "a</title>", "</title><title>a", "</title><title>a</title>b</title>", "<title>a</title><title>b</title>",
        "<TITLE>a</TITLE>", "<title lang='en'>a</title>", "<title>a</title >b</title>", "<svg><title>a</title></svg><title>b</title>", "<!-- <title>a</title> --><title>b</title>",
        "<script>'<title>'</script><title>a</title>",
    ]
    same_as_sql(spark, tmp_path, "html_title", [(i, f"http://e.com/{i}", x) for i, x in enumerate(htmls)])


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_training_data_operators():
    root = os.path.join(os.path.dirname(entry.__file__), "spindrift")
    for f in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            assert "spindrift.llm" not in open(f).read() and "from ..llm" not in open(f).read()
