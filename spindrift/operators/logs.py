"""Logs: search analytics, cost, tenancy, limits, latency, health, access. Inputs are tables of events."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- generic relational reads


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Latest wins: the row with the largest seq of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def newest(rows: DataFrame, by: str, n: int, *tie: str, where: dict | None = None) -> DataFrame:
    """The n newest rows that have all the given values."""
    for k, v in (where or {}).items():
        rows = rows.where(F.col(k) == v)
    return rows.orderBy(F.desc(by), *tie).limit(n)


def count_where(rows: DataFrame, **equal) -> DataFrame:
    for k, v in equal.items():
        rows = rows.where(F.col(k) == v)
    return rows.agg(F.count("*").alias("n"))


# -- search analytics: searches (event_id, ts, session_id, query, results_count, latency_ms), clicks (…, position)


def query_rollup(searches: DataFrame) -> DataFrame:
    return searches.groupBy("query").agg(
        F.count("*").alias("total"), F.round(F.avg("results_count"), 4).alias("avg_results"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"),
        F.count(F.when(F.col("results_count") == 0, 1)).alias("zero_results"), F.max("ts").alias("last_searched")
    )


def top_queries(searches: DataFrame, n: int = 10) -> DataFrame:
    return query_rollup(searches).orderBy(F.desc("total"), "query").limit(n)


def failed_queries(searches: DataFrame, n: int = 10) -> DataFrame:
    got = query_rollup(searches).where("zero_results > 0").select(
        "query", "total", "zero_results", F.round(F.col("zero_results") / F.col("total"), 4).alias("failure_rate")
    )
    return got.orderBy(F.desc("zero_results"), "query").limit(n)


def search_volume(searches: DataFrame, hours: int = 24, now: str | None = None) -> DataFrame:
    """hour, searches over the last hours; now: the latest search, if not given."""
    end = F.lit(now).cast("timestamp") if now else None
    if end is None:
        rows = searches.crossJoin(F.broadcast(searches.agg(F.max("ts").alias("_now"))))
        rows = rows.where(F.col("ts") >= F.col("_now") - F.expr(f"INTERVAL {hours} HOURS"))
    else:
        rows = searches.where(F.col("ts") >= end - F.expr(f"INTERVAL {hours} HOURS"))
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour")).agg(F.count("*").alias("searches"))


def click_through(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """ctr: sessions' queries that were clicked, of those searched."""
    s = searches.select("session_id", "query").distinct()
    hit = s.join(clicks.select("session_id", "query").distinct(), ["session_id", "query"], "left_semi").agg(F.count("*").alias("clicked"))
    return s.agg(F.count("*").alias("searched")).crossJoin(hit).select(F.round(
        F.when(F.col("searched") > 0, F.col("clicked") / F.col("searched")).otherwise(0.0), 4
    ).alias("ctr"))


def click_position(clicks: DataFrame) -> DataFrame:
    return clicks.agg(F.round(F.avg("position"), 2).alias("avg_position"))


def dashboard(searches: DataFrame, clicks: DataFrame) -> dict[str, DataFrame]:
    return {
        "ctr": click_through(searches, clicks), "avg_click_position": click_position(clicks), "top_queries": top_queries(searches),
        "failed_queries": failed_queries(searches), "volume": search_volume(searches)
    }


# -- cost: rows (ts, category, tenant_id, provider, cost_usd)


def llm_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (call_id, provider, model, input_tokens, output_tokens) with cost_usd; unknown models cost nothing. prices:
    provider, model, input_price, output_price for 1000 tokens."""
    rows = calls.join(prices, ["provider", "model"], "left").fillna(0.0, ["input_price", "output_price"])
    cost = F.col("input_tokens") / 1000.0 * F.col("input_price") + F.col("output_tokens") / 1000.0 * F.col("output_price")
    return rows.select("call_id", "provider", "model", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost_usd"))


def split_cost(calls: DataFrame) -> DataFrame:
    """Two rows for each call, its cost shared by tokens; in halves where there are none."""
    n = F.col("input_tokens") + F.col("output_tokens")
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.5)
    # Halves of a cost of six places are halves of the last place as well: both engines must round them alike.
    six = lambda x: F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
    part = lambda name, c: F.struct(
        F.lit(name).alias("category"), F.col(c).cast("double").alias("units"), six(F.col("cost_usd") * share(c)).alias("cost_usd")
    )
    return calls.select(
        "call_id", F.explode(F.array(part("llm_input", "input_tokens"), part("llm_output", "output_tokens"))).alias("x")
    ).select("call_id", "x.*")


def cheapest(prices: DataFrame, tier: int) -> DataFrame:
    return prices.where(F.col("tier") >= tier).orderBy("output_price", "provider", "model").limit(1)


def cost_summary(costs: DataFrame) -> DataFrame:
    """dimension, value, cost_usd, n, first, last: total, by category, by tenant and by provider, in one pass."""
    got = costs.groupingSets([["category"], ["tenant_id"], ["provider"], []], "category", "tenant_id", "provider").agg(
        F.grouping_id().alias("g"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    name = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "tenant").when(F.col("g") == 6, "provider").otherwise("total")
    return got.select(
        name.alias("dimension"), F.coalesce("category", "tenant_id", "provider", F.lit("")).alias("value"), "cost_usd", "n", "first", "last"
    )


def in_period(costs: DataFrame, hours: int, now: str) -> DataFrame:
    return costs.where(
        (F.col("ts") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= F.lit(now).cast("timestamp"))
    )


def budget_status(costs: DataFrame, budget: float, hours: int, now: str) -> DataFrame:
    spent = in_period(costs, hours, now).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent"))
    return spent.select(
        F.round("spent", 6).alias("spent"), F.lit(budget).alias("budget"), F.round(F.col("spent") / budget * 100, 2).alias("percentage"),
        (F.col("spent") >= budget).alias("over")
    )


# -- tenancy


def for_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """A tenant sees its own rows; "local" sees all."""
    return rows if tenant == "local" else rows.where(F.col("tenant_id") == tenant)


def scoped(source: Column, tenant: Column) -> Column:
    """A tenant's source by the name it has in a store that all tenants share."""
    return F.concat(F.lit("tenant:"), tenant, F.lit(":"), source)


def unscoped(source: Column) -> Column:
    return F.regexp_replace(source, "^tenant:[^:]*:", "")


def visible(rows: DataFrame, tenant: str, source: str = "source") -> DataFrame:
    """The rows whose source is the tenant's own or that of no tenant; "local" sees all."""
    own = F.col(source).startswith(f"tenant:{tenant}:") | ~F.col(source).startswith("tenant:")
    return rows if tenant == "local" else rows.where(own)


def quota_check(usage: DataFrame, quotas: DataFrame) -> DataFrame:
    """tenant_id, resource, used, allowed (used < most; without a quota it is)."""
    return usage.join(quotas, ["tenant_id", "resource"], "left").select(
        "tenant_id", "resource", "used", F.coalesce(F.col("used") < F.col("most"), F.lit(True)).alias("allowed")
    )


# -- limits


def accepted_per_minute(requests: DataFrame, limit: int, client: str = "session_id") -> DataFrame:
    """requests with accepted: the first `limit` of each client and minute."""
    w = Window.partitionBy(client, F.date_trunc("minute", "ts")).orderBy("ts", "event_id")
    return requests.withColumn("accepted", F.row_number().over(w) <= limit)


def accepted_sliding(requests: DataFrame, limit: int = 60, seconds: float = 60.0, client: str = "session_id") -> DataFrame:
    """event_id, client, accepted under a sliding window of accepted requests. Each decision depends on the ones before, so
    a client's requests are taken in order, batch by batch, in one task; what is held of them is the window alone. A client
    with a large share of the requests is one long task by that law; add the day to the client to bound it, where a window
    may begin anew each day."""

    def ordered(batches):
        last, held = None, deque()
        for b in batches:
            out = []
            for c, t in zip(b["client"], b["t"]):
                if c != last:
                    last, held = c, deque()
                while held and held[0] <= t - seconds:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(t)
            yield b[["event_id", "client"]].assign(accepted=out)

    rows = requests.select("event_id", F.col(client).alias("client"), F.col("ts").cast("double").alias("t"))
    return rows.repartition("client").sortWithinPartitions("client", "t", "event_id").mapInPandas(ordered, "event_id long, client long, accepted boolean")


# -- latency and health


def _cuts(rows: DataFrame, by: str, parts: int) -> Column:
    """The array of quantiles that cut rows into about equal parts by a number."""
    cuts = rows.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    return F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")


RANKS = (0.5, 0.95, 0.99)


def percentiles(rows: DataFrame, by: str, value: str, exact: bool = True, parts: int = 256) -> DataFrame:
    """n, mean, p50, p95, p99, min, max for each `by`, by the nearest rank s[int(n * p)]; exact=False sketches.

    Values are counted, and cut at quantiles into parts; the parts' counts, summed up, say in which part of a group a rank
    lies, and only these parts are put in order, each apart. So no task sees more than a part of a group's values."""
    name = {p: f"p{round(p * 100)}" for p in RANKS}
    if not exact:
        sketch = [F.round(F.percentile_approx(value, p), 2).alias(n) for p, n in name.items()]
        return rows.groupBy(by).agg(
            F.count("*").alias("n"), F.round(F.avg(value), 2).alias("mean"), *sketch, F.round(F.min(value), 2).alias("min"),
            F.round(F.max(value), 2).alias("max")
        )
    bounds = _cuts(rows, value, parts)
    per = rows.groupBy(by, value).agg(F.count("*").alias("c")).withColumn("part", F.size(F.filter(bounds, lambda c: c < F.col(value))))
    sums = per.groupBy(by, "part").agg(
        F.sum("c").alias("m"), F.sum(F.col(value) * F.col("c")).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    all_ = sums.groupBy(by).agg(
        F.sum("m").alias("n"), F.round(F.sum("total") / F.sum("m"), 2).alias("mean"), F.round(F.min("low"), 2).alias("min"),
        F.round(F.max("high"), 2).alias("max")
    )
    before = F.coalesce(F.sum("m").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.floor(F.col("n") * F.lit(p)).alias("at")) for p, n in name.items()]))
    wanted = all_.select(by, ranks.alias("r")).select(by, "r.name", "r.at")
    hit = sums.select(by, "part", "m", before.alias("start")).join(wanted, by).where("start <= at AND at < start + m").select(by, "part", "start", "name", "at")
    inside = per.join(hit.select(by, "part").distinct(), [by, "part"], "left_semi")
    running = inside.withColumn("upto", F.sum("c").over(Window.partitionBy(by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    found = running.join(hit, [by, "part"]).where(F.col("start") + F.col("upto") > F.col("at")).groupBy(by, "name").agg(F.min(value).alias("v"))
    wide = found.groupBy(by).agg(*[F.round(F.max(F.when(F.col("name") == n, F.col("v"))), 2).alias(n) for n in name.values()])
    return all_.join(wide, by).select(by, "n", "mean", *name.values(), "min", "max")


BUCKETS = (10, 50, 100, 200, 500, 1000)


def histogram(rows: DataFrame, value: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """le, count: cumulative, +Inf last."""
    got = rows.agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(str(b)) for b in buckets], F.count("*").alias("+Inf"))
    return got.select(F.explode(F.create_map(*[x for b in (*map(str, buckets), "+Inf") for x in (F.lit(b), F.col(f"`{b}`"))])).alias("le", "count"))


def prometheus(counts: DataFrame, name: str) -> DataFrame:
    """line: the rows of histogram() as a monitoring system reads them."""
    return counts.select(F.concat(F.lit(f'{name}_bucket{{le="'), "le", F.lit('"} '), F.col("count").cast("string")).alias("line"))


def registry(beats: DataFrame, now: str, stale_s: int) -> DataFrame:
    """service, instances, healthy, evicted of the last beat (service, instance, ts, draining) of each instance: stale ones are
    evicted, unless they are draining."""
    last = beats.groupBy("service", "instance").agg(F.max_by(F.struct("ts", "draining"), "ts").alias("b"))
    stale = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("b.ts") > stale_s
    gone = stale & ~F.col("b.draining")
    return last.groupBy("service").agg(
        F.count("*").alias("instances"), F.count(F.when(~stale, 1)).alias("healthy"), F.count(F.when(gone, 1)).alias("evicted")
    )


def breaker(calls: DataFrame, failures: int = 5, wait_s: float = 30.0) -> DataFrame:
    """event_id, service, state (in which the call came: closed, open, half_open), allowed of calls (event_id, service, ts, ok)
    in order. So many failures on end open a service's breaker; after the wait one call is let through, which closes it
    or opens it again. Each state depends on the calls before, so a service's calls are taken in order in one task; what
    is held of them is three numbers."""

    def ordered(batches):
        name, row, since = None, 0, None
        for b in batches:
            state, allowed = [], []
            for s, t, ok in zip(b["service"], b["t"], b["ok"]):
                if s != name:
                    name, row, since = s, 0, None
                now = "closed" if since is None else "half_open" if t - since >= wait_s else "open"
                state.append(now)
                allowed.append(now != "open")
                if now == "open":
                    continue
                if ok:
                    row, since = 0, None
                else:
                    row += 1
                    if now == "half_open" or row >= failures:
                        since = t
            yield b[["event_id", "service"]].assign(state=state, allowed=allowed)

    rows = calls.select("event_id", "service", F.col("ts").cast("double").alias("t"), "ok")
    kind = dict(rows.dtypes)["service"]
    return rows.repartition("service").sortWithinPartitions("service", "t", "event_id").mapInPandas(
        ordered, f"event_id long, service {kind}, state string, allowed boolean"
    )


def health(beats: DataFrame, now: str, stale_s: int) -> DataFrame:
    """service, last beat, healthy."""
    last = beats.groupBy("service").agg(F.max("ts").alias("last"), F.countDistinct("instance").alias("instances"))
    return last.withColumn("healthy", F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last") <= stale_s)


def round_robin(requests: DataFrame, instances: DataFrame) -> DataFrame:
    """event_id, instance: requests (event_id) dealt in turn over instances (instance, place from 0)."""
    turn = numbered(requests.select("event_id"), "event_id").crossJoin(F.broadcast(instances.agg(F.count("*").alias("n"))))
    return turn.withColumn("place", F.pmod(F.col("number") - 1, F.col("n")).cast("int")).join(instances, "place").select("event_id", "instance")


def numbered(rows: DataFrame, by: str, name: str = "number", parts: int = 256) -> DataFrame:
    """rows with their place from 1 in the order of `by`. Rows are cut at quantiles into parts that are numbered apart;
    the parts' counts, summed up, are what each begins at. No task sees more than a part."""
    bounds = _cuts(rows, by, parts)
    cut = rows.withColumn("_p", F.size(F.filter(bounds, lambda c: c < F.col(by))))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(by))
    return cut.withColumn("_i", own).join(F.broadcast(base), "_p").withColumn(name, F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def call_stats(calls: DataFrame, by: str) -> DataFrame:
    return calls.groupBy(by).agg(
        F.count("*").alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("failures"),
        F.round(F.avg(F.col("ok").cast("int")), 4).alias("success_rate"), F.round(F.avg("ms"), 4).alias("mean_ms")
    )


def sessions(activity: DataFrame, gap: str = "1 hour", client: str = "session_id") -> DataFrame:
    """client, start, end, events: activity until the gap has passed without any."""
    got = activity.groupBy(client, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return got.select(client, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def spans(trace: DataFrame) -> DataFrame:
    """trace_id, n_spans, duration_ms, errors of spans (trace_id, start_ms, end_ms, error)."""
    return trace.groupBy("trace_id").agg(
        F.count("*").alias("n_spans"), F.round(F.max("end_ms") - F.min("start_ms"), 4).alias("duration_ms"),
        F.count(F.when(F.col("error"), 1)).alias("errors")
    )


def retry_delay(attempt: Column, base: float = 1.0, most: float = 30.0) -> Column:
    return F.when(attempt <= 0, 0.0).otherwise(F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most)))


# -- access

# The permissions of each role.
ROLES = {
    "reader": ("search:read", "analytics:read"),
    "indexer": ("search:read", "index:write"),
    "operator": ("search:read", "index:write", "index:delete", "crawl:write", "analytics:read"),
    "agent_user": ("search:read", "agents:read", "agents:write"),
    "admin": (
        "search:read", "index:write", "index:delete", "crawl:write", "analytics:read", "agents:read", "agents:write", "tenants:manage", "admin:*"
    ),
}


def permissions(users: DataFrame) -> DataFrame:
    """users (user_id, roles) with permissions, in order."""
    roles = F.create_map(*[x for r, ps in ROLES.items() for x in (F.lit(r), F.array(*[F.lit(p) for p in ps]))])
    held = F.flatten(F.transform("roles", lambda r: F.coalesce(roles[r], F.array().cast("array<string>"))))
    return users.withColumn("permissions", F.array_sort(F.array_distinct(held)))


def endpoint_rule(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """path, rule: the exact rule (pattern, rule), else that of the longest pattern ending in / that the path begins with,
    else "authenticated"."""
    keys = F.concat(
        F.array("path"),
        F.filter(
            F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.substring("path", F.lit(1), n)),
            lambda p: p.endswith("/") & (p != F.col("path"))
        )
    )
    got = requests.select("path").distinct().select("path", F.explode(keys).alias("pattern")).join(rules, "pattern")
    best = got.groupBy("path").agg(F.max_by(
        "rule", F.when(F.col("pattern") == F.col("path"), 1_000_000).otherwise(F.length("pattern"))
    ).alias("rule"))
    return requests.join(best, "path", "left").select(*requests.columns, F.coalesce("rule", F.lit("authenticated")).alias("rule"))


def valid_tokens(tokens: DataFrame, issued: DataFrame, now: str) -> DataFrame:
    """tokens (token_hash) that were issued (token_hash, enabled, expires) and hold now."""
    ok = issued.where(F.col("enabled") & (F.col("expires").isNull() | (F.col("expires") > F.lit(now).cast("timestamp"))))
    return tokens.join(ok.select("token_hash"), "token_hash", "left_semi")


# -- bus

# The topics of the platform's events.
TOPICS = (
    "document.indexed", "document.deleted", "document.updated", "crawl.started", "crawl.page_fetched", "crawl.completed", "search.executed", "search.click", "embedding.started",
    "embedding.completed", "chunking.started", "chunking.completed", "agent.task.created", "agent.task.completed", "agent.task.failed", "workflow.started", "workflow.completed",
    "research.completed", "evaluation.completed", "rag.query.completed", "memory.session.created",
)


def envelope(events: DataFrame, cause: Column | None = None) -> DataFrame:
    """events (event_id, topic, any more) with correlation_id, that of the first event of a chain, and causation_id, that of the
    event before (cause, null at the beginning). A chain has one link here; longer ones keep the correlation_id they have."""
    by = F.lit(None).cast("string") if cause is None else cause.cast("string")
    own = F.col("event_id").cast("string")
    known = F.col("correlation_id") if "correlation_id" in events.columns else F.lit(None).cast("string")
    return events.withColumn("causation_id", by).withColumn("correlation_id", F.coalesce(known, by, own))



def glob_match(topic: Column, pattern: Column) -> Column:
    """fnmatch with * and ? on whole topics."""
    quoted = F.regexp_replace(pattern, r"([.\\+\[\](){}^$|])", r"\\$1")
    return F.regexp_like(topic, F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")))


def routed(events: DataFrame, routes: DataFrame) -> DataFrame:
    """event_id, handler for each route (pattern, handler) that fits the event's topic. Each distinct topic meets the
    routes once, topics (of which a platform has some tens) times routes (of which it has some hundreds); events join the
    result by topic."""
    topics = events.select("topic").distinct()
    fit = topics.join(routes, glob_match(F.col("topic"), F.col("pattern"))).select("topic", "handler").distinct()
    return events.join(fit, "topic").select("event_id", "handler")
