import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import logs
from spindrift.sources import tables, web
from spindrift.streaming import streams


@pytest.mark.parametrize(
    "url,base,want",
    [
        ("HTTPS://Example.COM:443/a/?b=2&a=1&utm_source=x#f", None, "https://example.com/a?a=1&b=2"),
        ("http://example.com", None, "http://example.com/"),
        ("./about", "https://example.com/x/", "https://example.com/x/about"),
        ("http://example.com:8080/", None, "http://example.com:8080/"),
        ("ftp://example.com/", None, None),
        ("", None, None),
        ("http://", None, None),
        ("http://[bad", None, None),
    ],
)
def test_urls(spark, url, base, want):
    full = web.resolve(url, base) if base else url
    assert spark.createDataFrame([(full,)], "u string").select(web.url_norm(F.col("u"))).first()[0] == want


def test_urls_of_odd_shape(spark):
    said = {
        "https://u:p@E.com/a//": "https://e.com/a", "http://e.com?q=a b&q=%C3%A9&Q=1&ref=z": "http://e.com/?Q=1&q=%C3%A9&q=a+b", "http://e.com:99999/": None,
        "http://e.com/?a": "http://e.com/?a=", "http://e.com/?a=1=2": "http://e.com/?a=1%3D2", "http://[::1]:80/x": "http://[::1]/x", " http://e.com/x#f?g ": "http://e.com/x", "http://e.com/a?fbclid=1": "http://e.com/a", "http://e.com/%zz?x=%zz": "http://e.com/%zz?x=%25zz",
    }
    got = {r.u: r.n for r in spark.createDataFrame([(u,) for u in said], "u string").select("u", web.url_norm(F.col("u")).alias("n")).collect()}
    assert {u: got[u] for u in said if u != "http://e.com/%zz?x=%zz"} == {u: n for u, n in said.items() if u != "http://e.com/%zz?x=%zz"}


def test_pages_and_robots(spark):
    html = "<html><head><title> T </title></head><body><nav>menu</nav><h1>H</h1><p>Hello <b>world</b></p><script>x</script><a href='/a#z'>a</a><a href='mailto:x'>m</a><a href='#t'>t</a></body>"
    assert web.read_page(html, "http://e.com/") == ("T", "T H Hello world a m t", ["http://e.com/a#z"])
    assert web.read_page("<h1>H</h1>")[0] == "H" and web.read_page(None) == ("Untitled", "", [])
    files = spark.createDataFrame(
        [("e.com", "# c\nUser-agent: *\nDisallow: /p\nAllow: /p/ok\n\nUser-agent: bot\nDisallow: /\nCrawl-delay: 2")], "host string, content string"
    )
    urls = spark.createDataFrame([(u,) for u in ("http://e.com/p/x", "http://e.com/p/ok/1", "http://e.com/", "http://f.com/p")], "url string")
    got = {r.url: r.allowed for r in web.robots_check(urls, web.robots_rules(files)).collect()}
    assert list(got[u] for u in ("http://e.com/p/x", "http://e.com/p/ok/1", "http://e.com/", "http://f.com/p")) == [False, True, True, True]
    assert not any(r.allowed for r in web.robots_check(
        urls.where("url LIKE '%e.com%'"), web.robots_rules(files, "bot").where("path = '/'")
    ).collect())


def test_robots_directives_and_frontier(spark):
    files = spark.createDataFrame(
        [("e.com", "User-agent: *\nCrawl-delay: 2\nSitemap: http://e.com/m\n\nUser-agent: bot\nCrawl-delay: 7\nCrawl-delay: x"), ("f.com", "")],
        "host string, content string"
    )
    assert {
        r.host: (r.crawl_delay, r.sitemaps) for r in web.robots_directives(files).collect()
    } == {"e.com": (2.0, ["http://e.com/m"]), "f.com": (None, [])}
    assert web.robots_directives(files, "bot").where("host = 'e.com'").first().crawl_delay == 7.0
    row = "url string, priority long, seq long"
    held = spark.createDataFrame([("a", 1, 1, "done"), ("b", 5, 2, "pending")], f"{row}, status string")
    found = spark.createDataFrame([("a", 0, 3), ("c", 3, 4), ("c", 2, 5), ("d", 9, 6), ("e", 1, 7)], row)
    got = web.enqueue(held, found, spark.createDataFrame([("e",)], "url string"), 2)
    assert {(r.url, r.priority, r.status) for r in got.collect()} == {("a", 1, "done"), ("c", 2, "pending"), ("b", 5, "pending")}


def test_crawl_of_many_levels_has_a_short_plan(spark, capsys):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "src string, dst string")
    got = web.crawl(links, spark.createDataFrame([("0",)], "url string"), 9, same_host=False)
    got.explain()
    assert capsys.readouterr().out.count("FileScan") == 10 and {(r.url, r.depth) for r in got.collect()} == {(str(i), i) for i in range(10)}


def test_crawl_keeps_the_host_and_the_depth(spark):
    links = spark.createDataFrame(
        [("http://a/1", "http://a/2"), ("http://a/2", "http://a/3"), ("http://a/1", "http://b/1"), ("http://a/3", "http://a/1")],
        "src string, dst string"
    )
    root = spark.createDataFrame([("http://a/1",)], "url string")
    assert {(r.url, r.depth) for r in web.crawl(links, root, 5).collect()} == {("http://a/1", 0), ("http://a/2", 1), ("http://a/3", 2)}
    assert {r.url for r in web.crawl(links, root, 1, same_host=False).collect()} == {"http://a/1", "http://a/2", "http://b/1"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("  ")
    (tmp_path / "c.md").write_text("no")
    got = tables.text_directory(spark, str(tmp_path))
    assert [(r.title, r.content) for r in got.collect()] == [("a", "one\ntwo")]
    assert tables.text_directory(spark, str(tmp_path), got.select("source")).count() == 0
    (tmp_path / "e.json").write_text('[{"query_id": "q1", "query": "x", "relevant_doc_ids": [1, 2], "relevance_scores": {"1": 3}}]')
    assert {(r.doc_id, r.grade) for r in tables.evaluation_set(spark, str(tmp_path / "e.json")).collect()} == {(1, 3.0), (2, 1.0)}
    (tmp_path / "s.json").write_text('{"Fast": ["Quick", "rapid"]}')
    assert tables.synonyms(spark, str(tmp_path / "s.json")).first().synonyms == ["quick", "rapid"]


def sliding(rows, limit, seconds):
    held, out = {}, {}
    for i, c, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        h = held[c] = [x for x in held.get(c, []) if x > t - seconds]
        out[i] = len(h) < limit
        if out[i]:
            h.append(t)
    return out


def test_sliding_limit_batch_and_stream(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(1, 5), 1.7e9 + rnd.randint(0, 300)) for i in range(400)]
    d = spark.createDataFrame(rows, "event_id long, session_id long, t double").withColumn("ts", F.timestamp_seconds("t"))
    want = sliding(rows, 4, 60.0)
    assert {r.event_id: r.accepted for r in logs.accepted_sliding(d, 4, 60.0).collect()} == want
    ev = d.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("session_id").alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit("{}").alias("props")
    )
    ev.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = streams.drain(streams.rate_limit(streams.events(spark, str(tmp_path)), 4, 60.0))
    assert {r.event_id: r.accepted for r in got.collect()} == want


def test_percentiles_with_a_hot_group_and_ties(spark):
    rnd = random.Random(8)
    rows = [("hot", float(rnd.choice([1, 1, 1, 2, rnd.random() * 100]))) for _ in range(4000)] + [(f"k{i % 3}", rnd.gauss(0, 9)) for i in range(500)]
    d = spark.createDataFrame(rows, "k string, v double")
    for parts in (4, 256):
        for r in logs.percentiles(d, "k", "v", parts=parts).collect():
            s = sorted(v for k, v in rows if k == r.k)
            assert (r.n, r.p50, r.p95, r.p99, r.min, r.max) == (
                len(s), *(round(s[int(len(s) * p)], 2) for p in (0.5, 0.95, 0.99)), round(s[0], 2), round(s[-1], 2)
            )


def plain_breaker(rows, failures, wait):
    out, held = {}, {}
    for i, s, t, ok in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        row, since = held.get(s, (0, None))
        state = "closed" if since is None else "half_open" if t - since >= wait else "open"
        out[i] = state
        if state == "open":
            continue
        row = 0 if ok else row + 1
        held[s] = (row, None) if ok else (row, t if state == "half_open" or row >= failures else since)
    return out


def test_circuit_breaker(spark):
    rnd = random.Random(2)
    rows = [(i, f"s{rnd.randint(0, 3)}", 1.7e9 + rnd.randint(0, 2000), rnd.random() < 0.4) for i in range(900)]
    d = spark.createDataFrame(rows, "event_id long, service string, t double, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = logs.breaker(d, 3, 30.0).collect()
    assert {r.event_id: r.state for r in got} == plain_breaker(rows, 3, 30.0) and all(r.allowed == (r.state != "open") for r in got)


def test_a_stream_in_update_mode_keeps_the_last_row_of_a_key(spark, tmp_path):
    for n in range(3):  # three files, a batch each
        ev = spark.range(4).selectExpr(
            f"id + {10 * n} AS event_id", f"TIMESTAMP_NTZ '2024-01-01 0{n}:30:00' AS ts", "id % 2 AS user_id", "'view' AS event_type", "1D AS value",
            "'{}' AS props"
        )
        ev.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    raw = streams.files(spark, str(tmp_path), "events", streams.EVENTS, per_batch=1)
    counts = raw.groupBy(F.col("user_id")).agg(F.count("*").alias("n"))
    assert {(r.user_id, r.n) for r in streams.drain(counts, "update", keys=["user_id"]).collect()} == {(0, 6), (1, 6)}


def test_cost_log(spark, tmp_path):
    c = spark.sql("SELECT 1L AS event_id, TIMESTAMP '2024-01-01' AS ts, 'llm' AS category, 't' AS tenant_id, 'p' AS provider, 0.5D AS cost_usd")
    for _ in range(2):
        tables.cost_log(c, str(tmp_path / "log"))
    back = tables.read_cost_log(spark, str(tmp_path / "log"))
    assert back.count() == 2 and back.distinct().collect() == c.collect()


def test_log_operators(spark):
    d = spark.createDataFrame([("a", float(v)) for v in range(100)] + [("b", 5.0)], "k string, v double")
    p = {r.k: r for r in logs.percentiles(d, "k", "v").collect()}
    assert (p["a"].p50, p["a"].p95, p["a"].p99, p["a"].min, p["a"].max, p["b"].p99) == (50.0, 95.0, 99.0, 0.0, 99.0, 5.0)
    assert [r.number for r in logs.numbered(
        spark.range(1000).withColumn("x", F.col("id") * 3), "x", parts=7
    ).orderBy("x").collect()] == list(range(1, 1001))
    h = {r.le: r["count"] for r in logs.histogram(d, "v", (10, 50)).collect()}
    assert h == {"10": 12, "50": 52, "+Inf": 101}
    t = spark.createDataFrame([("events.view",), ("events.x.y",)], "topic string")
    assert [r[0] for r in t.select(logs.glob_match(F.col("topic"), F.lit("events.*w"))).collect()] == [True, False]
    users = spark.createDataFrame([(1, ["admin"]), (2, ["nobody"])], "user_id int, roles array<string>")
    assert {r.user_id: len(r.permissions) for r in logs.permissions(users).collect()} == {1: 9, 2: 0}
