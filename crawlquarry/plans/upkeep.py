"""Queries of requeueing, leases, telemetry, extraction, host events and upkeep, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlquarry.functions import html
from crawlquarry.operators import heads, hosts, linkgraph, reports, requeue, telemetry
from crawlquarry.plans import sql as S
from crawlquarry.plans.catalog import _html, _pages, _snap, _tasks, _TASKS, query
from crawlquarry.plans.sql import NOW
from crawlquarry.session import materialize, table

_PATH = "lower(regexp_extract({u}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1))"
_NET = "regexp_extract({u}, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"

# --- requeueing and leases ------------------------------------------------------------------


@query("requeue_urls", f"WITH {S.LEDGER}, {S.PAGES}, w AS (SELECT DISTINCT {S.normalize('url')} AS url FROM pg WHERE status >= 500) SELECT url, host, 'scheduled' AS physical_queue, discovery_value AS scheduler_score, CAST({NOW} AS DOUBLE) AS next_fetch_at, 'retry' AS current_intent, fail_streak FROM ledger WHERE url IN (SELECT url FROM w WHERE strlen(url) <= 8192)")
def requeue_urls(spark, d):
    """Known URLs whose page came with a server error, back for a retry."""
    rows = requeue.requeue_urls(_snap(spark, d), _pages(spark, d).where("status >= 500").select("url"), intent="retry")
    return rows.drop("added_at", "branch_key")


@query("requeue_refresh_urls", f"WITH {S.LEDGER}, {S.PAGES}, w AS (SELECT DISTINCT {S.normalize('url')} AS url FROM pg WHERE crawled_at < {NOW - 86400 * 30}) SELECT url, host, 'refresh' AS physical_queue, CAST({NOW + 60} AS DOUBLE) AS next_fetch_at, {S.branch('url')} AS branch_key, 'refresh' AS current_intent FROM ledger WHERE url IN (SELECT url FROM w WHERE strlen(url) <= 8192)")
def requeue_refresh_urls(spark, d):
    """Pages crawled over a month ago, for a refresh in a minute."""
    rows = requeue.requeue_refresh_urls(_snap(spark, d), _pages(spark, d).where(F.col("crawled_at") < NOW - 86400 * 30).select("url"), at=NOW + 60)
    return rows.select("url", "host", "physical_queue", "next_fetch_at", "branch_key", "current_intent")


@query("place_many", f"""WITH {_TASKS}, {S.LEDGER}, {S.QUEUE}, j AS (SELECT t.*, l.url IS NULL AS is_new, l.terminal_reason IS NULL AND l.last_success_at IS NULL AS open,
      l.discovery_value < t.value OR (l.source_url IS NULL AND t.source_url IS NOT NULL) OR l.added_at > t.added_at OR l.next_fetch_at > t.next_fetch_at OR t.intent IS DISTINCT FROM l.current_intent AS better FROM tasks t LEFT JOIN ledger l ON l.url = t.url),
    n AS (SELECT count(*) FILTER (is_new) AS inserted, count(*) FILTER (NOT is_new AND open AND better) AS updated, count(*) FILTER ((is_new OR open) AND url NOT IN (SELECT url FROM q)) AS admitted FROM j)
    SELECT inserted, updated, admitted, CASE WHEN admitted = 0 AND inserted + updated > 0 THEN 0 ELSE inserted + updated END AS placed FROM n""")
def place_many(spark, d):
    return requeue.place_many(_snap(spark, d), _tasks(spark, d))


@query("delay_overcrowded", f"""WITH {S.SNAPSHOT}, r AS (SELECT url, row_number() OVER (PARTITION BY host ORDER BY scheduler_score DESC, next_fetch_at, added_at, url, physical_queue) AS hr, row_number() OVER (PARTITION BY host, branch_key ORDER BY scheduler_score DESC, next_fetch_at, added_at, url, physical_queue) AS br FROM q WHERE physical_queue = 'scheduled' AND next_fetch_at <= {NOW}),
    c AS (SELECT url FROM r WHERE hr > 5 OR br > 2 ORDER BY hr DESC, br DESC, url LIMIT 200)
    SELECT url, host, 'scheduled' AS physical_queue, discovery_value AS scheduler_score, greatest(next_fetch_at, {NOW + 3600}) AS next_fetch_at FROM ledger WHERE url IN (SELECT url FROM c)""")
def delay_overcrowded(spark, d):
    return requeue.delay_overcrowded(_snap(spark, d), 5, 2, 200, 3600.0).select("url", "host", "physical_queue", "scheduler_score", "next_fetch_at")


@query("finalize_successes")
def finalize_successes(spark, d):
    """(part, changes) of a batch of all pages that came with status 200 and their links."""
    s, p = _snap(spark, d), _pages(spark, d)
    done = p.where("status = 200").select(F.col("url_hash").alias("seq"), "url", (F.col("crawled_at") - F.floor("crawled_at") + 0.05).alias("ms"))
    parts = requeue.finalize_successes(s, done, _tasks(spark, d))
    out = None
    for name, f in parts.items():
        row = f.agg(F.count("*").alias("changes")).select(F.lit(name).alias("part"), "changes")
        out = row if out is None else out.unionByName(row)
    return out


_LEASABLE = f"SELECT p.*, hs.latency_ewma_ms FROM pend p LEFT JOIN hs ON hs.host_key = p.host WHERE {S.RUNNABLE} AND p.url IN (SELECT url FROM ledger WHERE terminal_reason IS NULL)"
_CANDIDATES = f"WITH {S.SNAPSHOT}, {S.HEADS}, cand AS (SELECT * FROM hd WHERE runnable_at <= {NOW} ORDER BY execution_tier, runnable_url_count, latency_penalty, head_next_fetch_at, head_added_at, head_scheduler_score DESC, physical_queue, head_url LIMIT 128), la AS ({_LEASABLE}), f AS (SELECT cand.*, EXISTS (SELECT 1 FROM la WHERE la.url = cand.head_url AND la.physical_queue = cand.physical_queue) AS live FROM cand)"


def _leased(spark, d):
    s = _snap(spark, d)
    return requeue.lease_from_heads(s, heads.host_heads(s.queue, s.host_state, s.host_ledger, NOW), 32)


@query("lease_protocol", f"{_CANDIDATES} SELECT head_url AS url, host, physical_queue FROM f WHERE live ORDER BY execution_tier, runnable_url_count, latency_penalty, head_next_fetch_at, head_added_at, head_scheduler_score DESC, physical_queue, head_url LIMIT 32")
def lease_protocol(spark, d):
    return _leased(spark, d)[0]


@query("lease_protocol_diag", f"{_CANDIDATES} SELECT CASE WHEN count(*) FILTER (live) > 0 THEN 'hit' WHEN count(*) FILTER (NOT live) > 0 THEN 'stale' ELSE 'miss' END AS outcome, count(*) AS candidates, count(*) FILTER (NOT live) AS stale, count(*) FILTER (live) = 0 AS scanned FROM f")
def lease_protocol_diag(spark, d):
    return _leased(spark, d)[1]


# --- telemetry ------------------------------------------------------------------------------

_FIELDS = [(part, f) for part, fields in telemetry.STAGES.items() for f in fields]
_NAMES = ", ".join(f"('{p}', '{f}', {i})" for i, (p, f) in enumerate(_FIELDS))


@query("telemetry_timings", f"""WITH n AS (SELECT * FROM (VALUES {_NAMES}) t(part, field, i)), e AS (SELECT event_id % {len(_FIELDS) + 3} AS i, value AS ms FROM events WHERE value IS NOT NULL)
    SELECT n.part, n.field, count(e.ms) AS count, round(coalesce(avg(e.ms), 0.0), 1) AS avg, round(coalesce(quantile_disc(e.ms, 0.5), 0.0), 1) AS p50, round(coalesce(quantile_disc(e.ms, 0.95), 0.0), 1) AS p95, round(coalesce(max(e.ms), 0.0), 1) AS max FROM n LEFT JOIN e ON e.i = n.i AND n.i <> 7 GROUP BY 1, 2""")
def telemetry_timings(spark, d):
    """Events stand for samples of the timed fields; one field has none."""
    names = spark.createDataFrame([(p, f, i) for i, (p, f) in enumerate(_FIELDS) if i != 7], "part string, field string, i long")
    e = table(spark, d, "events").select((F.col("event_id") % (len(_FIELDS) + 3)).alias("i"), F.col("value").alias("ms"))
    return telemetry.timing_summaries(e.join(F.broadcast(names), "i").select("part", "field", "ms"))


@query("telemetry_labels", "SELECT label, value, count(*) AS n FROM (SELECT unnest(['fetch_outcome', 'robots_status', 'lease_outcome', 'storage_truncated']) AS label, unnest([event_type, CASE WHEN user_id % 7 = 0 THEN 'denied' ELSE 'allowed' END, CASE WHEN event_id % 5 = 0 THEN 'stale' WHEN event_id % 11 = 0 THEN NULL ELSE 'hit' END, CASE WHEN value > 50 THEN 'true' ELSE 'false' END]) AS value FROM events WHERE value IS NOT NULL) WHERE value IS NOT NULL GROUP BY 1, 2")
def telemetry_labels(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL")
    attempts = e.select(
        F.col("event_type").alias("fetch_outcome"), F.when(F.col("user_id") % 7 == 0, "denied").otherwise("allowed").alias("robots_status"),
        F.when(F.col("event_id") % 5 == 0, "stale").when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise("hit").alias("lease_outcome"), (F.col("value") > 50).alias("storage_truncated"),
    )
    return telemetry.label_counts(attempts)


@query("queue_waits", "WITH e AS (SELECT event_type AS queue, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS wait, CAST(user_id % 97 AS INT) AS depth FROM events) SELECT queue, coalesce(arg_max(wait, (ts, event_id)) FILTER (wait IS NOT NULL), 0.0) AS last_ms, coalesce(max(wait), 0.0) AS max_ms, max(depth) AS max_depth FROM e GROUP BY 1")
def queue_waits(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("wait_ms"), (F.col("user_id") % 97).cast("int").alias("depth"))
    return telemetry.queue_waits(e)


@query("cycle_snapshots", f"""WITH {S.PAGES}, c AS (SELECT CAST(floor(crawled_at / 86400) AS BIGINT) AS cycle, crawled_at AS tm, coalesce(status >= 400, true) AS failed FROM pg), g AS (SELECT cycle, min(tm) AS started_at, max(tm) AS ended_at, count(*) FILTER (NOT failed) AS pages, count(*) FILTER (failed) AS failures FROM c GROUP BY 1)
    SELECT *, round(ended_at - started_at, 3) AS elapsed, CASE WHEN ended_at > started_at THEN round(pages / (ended_at - started_at), 3) ELSE 0.0 END AS pages_a_second FROM g""")
def cycle_snapshots(spark, d):
    """Days stand for cycles."""
    return telemetry.cycle_snapshots(_pages(spark, d).select(F.floor(F.col("crawled_at") / 86400).cast("long").alias("cycle"), F.col("crawled_at").alias("at"), F.coalesce(F.col("status") >= 400, F.lit(True)).alias("failed")))


@query("worker_pools", """WITH c AS (SELECT CAST(n AS INT) AS concurrency, r AS probing_ratio FROM (SELECT unnest(range(0, 41)) AS n), (SELECT unnest([0.0, 0.25, 0.5, 1.5]) AS r)), t AS (SELECT *, greatest(1, concurrency) AS total, CASE WHEN concurrency >= 4 THEN 1 ELSE 0 END AS refresh FROM c),
    n AS (SELECT *, total - refresh AS normal, least(1.0, greatest(0.0, probing_ratio)) AS ratio FROM t), p AS (SELECT *, CASE WHEN normal <= 1 OR ratio <= 0 THEN 0 ELSE least(normal - 1, greatest(1, CAST(round_even(normal * ratio, 0) AS INT))) END AS probing FROM n)
    SELECT concurrency, CAST(probing_ratio AS DOUBLE) AS probing_ratio, CAST(normal AS INT) AS normal, CAST(refresh AS INT) AS refresh, CAST(normal - probing AS INT) AS warm, CAST(probing AS INT) AS probing, CAST(greatest(16, 4 * total) AS INT) AS queue_depth FROM p""")
def worker_pools(spark, d):
    ratios = F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 1.5)))).alias("probing_ratio")
    return telemetry.worker_pools(spark.range(41).select(F.col("id").cast("int").alias("concurrency"), ratios))


# --- extraction -----------------------------------------------------------------------------


@query("css_first", f"WITH {S.PAGES} SELECT url_hash, nullif(trim(coalesce(title, '')), '') AS lead, list_filter(coalesce(outlinks, []), lambda u: u <> '')[1] AS href FROM pg")
def css_first(spark, d):
    h = _html(spark, d)
    return h.select("url_hash", html.css_first(F.col("html"), "body > p.lead").alias("lead"), html.css_first(F.col("html"), "a[href]", "href").alias("href"))


@query("extract_all", f"WITH {S.PAGES} SELECT url_hash, CASE WHEN trim(coalesce(title, '')) = '' THEN [] ELSE [trim(title)] END AS lead, list_filter(list_transform(coalesce(outlinks, []), lambda u: trim(u)), lambda u: u <> '') AS anchors FROM pg")
def extract_all(spark, d):
    h = _html(spark, d).select("url_hash", html.extract_all(F.col("html"), {"lead": "p.lead", "anchors": "a"}).alias("m"))
    return h.select("url_hash", F.col("m")["lead"].alias("lead"), F.col("m")["anchors"].alias("anchors"))


@query("raw_links", f"WITH {S.PAGES} SELECT url_hash, list_transform(coalesce(outlinks, []), lambda u: u || ' ' || trim(u)) AS links FROM pg")
def raw_links(spark, d):
    """Anchors as they're written, href and text in one string."""
    return _html(spark, d).select("url_hash", F.transform(html.links_column(F.col("html")), lambda s: F.concat_ws(" ", s["href"], s["text"])).alias("links"))


@query("images", f"WITH {S.PAGES} SELECT url_hash, [url || ' ' || host, url || ' '] AS images FROM pg")
def images(spark, d):
    """Images of a page whose HTML has two of them, one without a text."""
    h = _html(spark, d).withColumn("html", F.concat("html", F.lit('<img src="'), "url", F.lit('" alt="'), "host", F.lit('"><img src="'), "url", F.lit('">')))
    return h.select("url_hash", F.transform(html.images_column(F.col("html")), lambda s: F.concat_ws(" ", s["src"], s["alt"])).alias("images"))


@query("link_check_reach", f"""WITH RECURSIVE {S.PAGES}, edges AS (SELECT DISTINCT url AS source, unnest(outlinks) AS target FROM pg WHERE outlinks IS NOT NULL), onward AS (SELECT source, target, {_NET.format(u='source')} = {_NET.format(u='target')} AND regexp_matches({_PATH.format(u='target')}, '(^|/|\\.html|\\.htm|\\.php|\\.asp|\\.aspx)$') AND ({_PATH.format(u='target')} = '' OR regexp_matches({_PATH.format(u='target')}, '(/|\\.html|\\.htm|\\.php|\\.asp|\\.aspx)$')) AS go FROM edges),
    walk AS (SELECT DISTINCT url, 0 AS depth FROM url_ledger WHERE source_url IS NULL UNION SELECT e.target, w.depth + 1 FROM walk w JOIN onward e ON e.source = w.url WHERE w.depth < 3 AND e.go),
    visited AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url), checked AS (SELECT e.target AS url, v.depth + 1 AS depth FROM visited v JOIN onward e ON e.source = v.url WHERE v.depth < 3 UNION ALL SELECT * FROM visited) SELECT url, min(depth) AS depth FROM checked GROUP BY url""")
def link_check_reach(spark, d):
    edges = _pages(spark, d).where("outlinks IS NOT NULL").select(F.col("url").alias("source"), F.explode("outlinks").alias("target"))
    return linkgraph.check_reach(edges, table(spark, d, "url_ledger").where("source_url IS NULL").select("url"), 3)


# --- host events and upkeep -----------------------------------------------------------------

_EVENTS = f"""{S.LEDGER}, ev AS (SELECT host, 'discovered' AS kind, added_at AS tm, 1 AS n, NULL AS robots FROM ledger WHERE host IS NOT NULL UNION ALL SELECT host, 'success', last_success_at, NULL, NULL FROM ledger WHERE host IS NOT NULL AND last_success_at IS NOT NULL
    UNION ALL SELECT host, 'failure', terminalized_at, NULL, NULL FROM ledger WHERE host IS NOT NULL AND last_error IS NOT NULL AND terminalized_at IS NOT NULL UNION ALL SELECT host, 'robots', next_fetch_at + 1, NULL, CASE WHEN fail_streak > 1 THEN 'denied' ELSE 'allowed' END FROM ledger WHERE host IS NOT NULL AND url_length % 17 = 0)"""


@query("host_ledger_events", f"""WITH {_EVENTS}, e AS (SELECT host, min(tm) FILTER (kind = 'discovered') AS f, min(tm) AS any_, max(tm) AS l, max(tm) FILTER (kind = 'success') AS ok, max(tm) FILTER (kind = 'failure') AS bad, max(tm) FILTER (kind = 'robots') AS rb, count(*) FILTER (kind = 'discovered') AS k, count(*) FILTER (kind = 'success') AS s, count(*) FILTER (kind = 'failure') AS x FROM ev GROUP BY host),
    hl AS (SELECT * REPLACE (lower(host) AS host) FROM host_ledger)
    SELECT coalesce(hl.host, e.host) AS host, coalesce(least(hl.first_seen_at, e.f), e.any_) AS first_seen_at, greatest(hl.last_seen_at, e.l) AS last_seen_at, greatest(hl.last_success_at, e.ok) AS last_success_at, greatest(hl.last_failure_at, e.bad) AS last_failure_at, coalesce(hl.known_url_count, 0) + coalesce(e.k, 0) AS known_url_count, coalesce(hl.success_count, 0) + coalesce(e.s, 0) AS success_count, coalesce(hl.failure_count, 0) + coalesce(e.x, 0) AS failure_count,
    coalesce(e.rb, hl.robots_last_checked_at) AS robots_last_checked_at, CASE WHEN e.rb IS NOT NULL THEN (SELECT max(v.robots) FROM ev v WHERE v.host = e.host AND v.kind = 'robots' AND v.tm = e.rb) ELSE hl.robots_status END AS robots_status FROM hl FULL JOIN e ON e.host = hl.host""")
def host_ledger_events(spark, d):
    """Host ledger after the events that the URL ledger tells of: discoveries, successes, failures, robots checks."""
    s = _snap(spark, d)
    l = s.ledger.where("host IS NOT NULL")
    null = F.lit(None)
    row = lambda kind, at, n=null.cast("int"), robots=null.cast("string"): ("host", F.lit(kind).alias("kind"), at.alias("at"), n.alias("n"), robots.alias("robots_status"))
    events = l.select(*row("discovered", F.col("added_at"), F.lit(1))).unionByName(l.where("last_success_at IS NOT NULL").select(*row("success", F.col("last_success_at"))))
    events = events.unionByName(l.where("last_error IS NOT NULL AND terminalized_at IS NOT NULL").select(*row("failure", F.col("terminalized_at"))))
    events = events.unionByName(l.where("url_length % 17 = 0").select(*row("robots", F.col("next_fetch_at") + 1, robots=F.when(F.col("fail_streak") > 1, "denied").otherwise("allowed"))))
    return hosts.ledger_after_events(s.host_ledger, events).drop("registrable_domain")


@query("host_state_robots", f"""WITH {S.STATE}, {S.LEDGER}, want AS (SELECT DISTINCT host FROM ledger WHERE host IS NOT NULL), al AS (SELECT host_key, crawl_delay_seconds, robots_checked_at FROM hs UNION ALL SELECT host, 0.5, 0.0 FROM want WHERE host NOT IN (SELECT host_key FROM hs)), c AS (SELECT host, max((next_fetch_at, url_length % 9)) AS t FROM ledger WHERE host IS NOT NULL AND url_length % 17 = 0 GROUP BY host),
    m AS (SELECT host, max(next_fetch_at) AS at FROM ledger WHERE host IS NOT NULL AND url_length % 17 = 0 GROUP BY host)
    SELECT al.host_key, CASE WHEN m.host IS NULL THEN al.crawl_delay_seconds ELSE (SELECT CAST(max(g.url_length % 9) AS DOUBLE) FROM ledger g WHERE g.host = m.host AND g.next_fetch_at = m.at AND g.url_length % 17 = 0) END AS crawl_delay_seconds, coalesce(m.at, al.robots_checked_at) AS robots_checked_at FROM al LEFT JOIN m ON m.host = al.host_key""")
def host_state_robots(spark, d):
    """States of all hosts of the ledger, fresh ones where there was none, after robots checks."""
    s = _snap(spark, d)
    l = s.ledger.where("host IS NOT NULL")
    states = hosts.with_new_hosts(s.host_state, l.select(F.col("host").alias("host_key")), 0.5, NOW)
    checks = l.where("url_length % 17 = 0").select(F.col("host").alias("host_key"), (F.col("url_length") % 9).cast("double").alias("crawl_delay_seconds"), F.col("next_fetch_at").alias("checked_at"))
    return hosts.after_robots(states, checks).select("host_key", "crawl_delay_seconds", "robots_checked_at")


@query("heads_refreshed", f"WITH {S.SNAPSHOT}, {S.HEADS.replace('FROM q LEFT JOIN', 'FROM pend q LEFT JOIN')} SELECT * FROM hd")
def heads_refreshed(spark, d):
    """Heads of the pending rows, from the heads of the whole queue by refreshing only the hosts that blocked and leased rows touch."""
    s = _snap(spark, d)
    gone = s.blocked.select("url", "physical_queue").unionByName(s.leases.select("url", "physical_queue"))
    dirty = s.queue.join(gone, ["url", "physical_queue"], "left_semi").select("physical_queue", "host").distinct()
    before = heads.host_heads(s.queue, s.host_state, s.host_ledger, NOW)
    return heads.refreshed_heads(before, materialize(dirty, "dirty"), s.pending, s.host_state, s.host_ledger, NOW)


@query("maintenance_cycle")
def maintenance_cycle(spark, d):
    """(step, changes) of one round of upkeep, each step on the state the last one left."""
    _, changes = requeue.apply_upkeep(_snap(spark, d), _pages(spark, d), {}, materialize)
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(changes.items())], "position int, step string, changes long")


@query("operator_summary", f"""WITH {S.SNAPSHOT}, {S.PAGES}, {S.HEADS}, st AS (SELECT CASE WHEN l.terminal_reason IS NOT NULL THEN 'terminal' WHEN p.state IS NOT NULL THEN p.state WHEN l.last_success_at IS NOT NULL THEN 'done' ELSE 'discovered' END AS state FROM ledger l LEFT JOIN (SELECT url, physical_queue AS state FROM pend UNION ALL SELECT url, 'blocked' FROM blocked UNION ALL SELECT url, 'leased' FROM leases) p ON p.url = l.url),
    t AS (SELECT count(*) FILTER (state IN ('runnable', 'scheduled', 'refresh')) AS pending, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'blocked') AS blocked, count(*) FILTER (state = 'terminal') AS terminal, count(*) FILTER (state = 'done') AS done, count(*) AS total FROM st),
    h AS (SELECT count(DISTINCT host) FILTER (runnable_at <= {NOW}) AS runnable_hosts, min(greatest(runnable_at - {NOW}, 0.0)) AS next_delay FROM hd)
    SELECT t.*, (SELECT count(*) FROM pg) AS pages, (SELECT count(DISTINCT host) FROM pg) AS page_hosts, (SELECT max(crawled_at) FROM pg) AS last_crawl_at, h.runnable_hosts, h.next_delay, 'heads' AS readiness_source,
    (SELECT count(*) FROM ledger WHERE last_error IS NOT NULL AND last_error <> '' AND (terminal_reason IS NOT NULL OR url IN (SELECT url FROM q))) AS active_errors, CASE WHEN runnable_hosts > 0 THEN 'ready' WHEN pending > 0 THEN 'waiting' WHEN blocked > 0 THEN 'blocked' ELSE 'idle' END AS health FROM t, h""")
def operator_summary(spark, d):
    s = _snap(spark, d)
    return reports.operator_summary(s, _pages(spark, d), heads.host_heads(s.queue, s.host_state, s.host_ledger, NOW))
