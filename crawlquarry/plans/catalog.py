"""Queries of the core operators over a data directory, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlquarry.functions import content, html, policy, urls
from crawlquarry.operators import discovery, frontier, heads, hosts, invariants, linkgraph, reports, skew, transitions
from crawlquarry.plans import sql as S
from crawlquarry.plans.sql import NOW
from crawlquarry.session import materialize, table
from crawlquarry.sources import stores
from crawlquarry.streaming import hoststate

_QUERIES, _SQL = {}, {}


def query(name: str, text: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if text:
            _SQL[name] = text
        return f

    return register


def _snap(spark, d):
    return frontier.snapshot(spark, d, NOW)


def _pages(spark, d):
    return frontier.pages(table(spark, d, "pages"))


def _heads(spark, d):
    s = _snap(spark, d)
    return heads.host_heads(s.queue, s.host_state, s.host_ledger, NOW)


def _live(spark, d):
    s = _snap(spark, d)
    return heads.live_heads(s.queue, s.host_state, NOW)


# --- keys that hold most rows -------------------------------------------------------------


@query(
    "p3_found",
    """WITH a AS (SELECT DISTINCT lower(host) AS host, url AS v FROM url_ledger WHERE host IS NOT NULL AND url IS NOT NULL), b AS (SELECT DISTINCT lower(host) AS host, url_hash AS v FROM pages WHERE host IS NOT NULL AND url_hash IS NOT NULL)
    SELECT 'url_ledger' AS relation_name, host FROM a GROUP BY host HAVING count(*) * 100 >= 3 * (SELECT count(DISTINCT v) FROM a)
    UNION ALL SELECT 'pages', host FROM b GROUP BY host HAVING count(*) * 100 >= 3 * (SELECT count(DISTINCT v) FROM b)""",
)
def p3_found(spark, d):
    a = skew.heavy_keys(table(spark, d, "url_ledger"), F.lower("host"), F.col("url"), 3)
    b = skew.heavy_keys(table(spark, d, "pages"), F.lower("host"), F.col("url_hash"), 3)
    return a.select(F.lit("url_ledger").alias("relation_name"), F.col("key").alias("host")).unionByName(b.select(F.lit("pages").alias("relation_name"), F.col("key").alias("host")))


@query(
    "p3_profile",
    """WITH r AS (SELECT lower(host) AS host, last_error, url_length FROM url_ledger WHERE host IS NOT NULL), g AS (SELECT host, count(*) AS rows, count(DISTINCT last_error) AS errors FROM r GROUP BY host),
    m AS (SELECT host, last_error, n, row_number() OVER (PARTITION BY host ORDER BY n DESC, last_error) AS rn FROM (SELECT host, last_error, count(*) AS n FROM r WHERE last_error IS NOT NULL GROUP BY 1, 2)),
    p AS (SELECT host, quantile_disc(url_length, 0.5) AS p50, quantile_disc(url_length, 0.9) AS p90, quantile_disc(url_length, 0.99) AS p99 FROM r WHERE url_length IS NOT NULL GROUP BY host)
    SELECT g.host, g.rows, g.errors, m.last_error AS mode_error, coalesce(m.n, 0) AS mode_rows, p.p50, p.p90, p.p99 FROM g LEFT JOIN m ON m.host = g.host AND m.rn = 1 LEFT JOIN p ON p.host = g.host""",
)
def p3_profile(spark, d):
    raw = table(spark, d, "url_ledger")
    errors = skew.key_summary(skew.weighted_values(raw, F.lower("host"), F.col("last_error")))
    lengths = skew.percentiles(skew.weighted_values(raw, F.lower("host"), F.col("url_length")), {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return errors.join(lengths, "key", "left").select(F.col("key").alias("host"), "rows", F.col("distinct").alias("errors"), F.col("mode").alias("mode_error"), "mode_rows", "p50", "p90", "p99")


# --- sources and sinks ----------------------------------------------------------------------


@query("pages_list", f"WITH {S.PAGES} SELECT url_hash, url, host, title, status, crawled_at FROM pg WHERE crawled_at > 1755000000 ORDER BY crawled_at, url_hash LIMIT 100 OFFSET 50")
def pages_list(spark, d):
    return stores.list_pages(_pages(spark, d), since=1755000000.0, limit=100, offset=50).select("url_hash", "url", "host", "title", "status", "crawled_at")


@query("page_get", f"WITH {S.PAGES} SELECT pg.url_hash, pg.title, CASE WHEN coalesce(pg.stored_content_bytes, 0) > 0 THEN coalesce(c.content, '') ELSE '' END AS content FROM pg LEFT JOIN page_content c ON c.url_hash = pg.url_hash")
def page_get(spark, d):
    return stores.with_bodies(_pages(spark, d), table(spark, d, "page_content")).select("url_hash", "title", "content")


@query("pages_upsert", f"""WITH {S.PAGES}, first AS (SELECT url_hash, min(created_at) AS created_at, arg_min(url, (created_at, crawled_at, url, host)) AS url, arg_min(lower(host), (created_at, crawled_at, url, host)) AS host FROM pages WHERE url_hash IS NOT NULL GROUP BY url_hash)
    SELECT pg.url_hash, first.url, first.host, pg.status, pg.crawled_at, pg.storage_tier, first.created_at FROM pg JOIN first USING (url_hash)""")
def pages_upsert(spark, d):
    """All pages, those of one half of the keys' crawls saved before the others."""
    raw = table(spark, d, "pages")
    earlier = F.pmod(F.xxhash64("url_hash", "crawled_at"), F.lit(2)) == 0
    return stores.upsert_pages(raw.where(earlier), raw.where(~earlier)).select("url_hash", "url", "host", "status", "crawled_at", "storage_tier", "created_at")


@query("results_jsonl")
def results_jsonl(spark, d):
    return stores.results_as_json(_pages(spark, d), drop=("outlinks",))


@query("runtime_latest", """SELECT event_type AS component, k, updated_at FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch(ts) AS updated_at, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def runtime_latest(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("component"), F.col("props").alias("payload"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("updated_at"), F.col("event_id").alias("seq"))
    return stores.latest_payloads(e).select("component", F.get_json_object("payload", "$.k").cast("long").alias("k"), "updated_at")


@query("relation_sizes")
def relation_sizes(spark, d):
    return stores.relation_sizes(spark, d, ("url_ledger", "pages", "page_content", "scheduler_queue", "host_ledger", "host_state"))


@query("seed_urls", f"WITH {S.LEDGER} SELECT url FROM ledger WHERE source_url IS NULL AND terminal_reason IS NULL")
def seed_urls(spark, d):
    l = _snap(spark, d).ledger
    return stores.enabled_seeds(l.where("source_url IS NULL").select("url", F.col("terminal_reason").isNull().alias("enabled"))).select("url")


# --- URL and host functions -----------------------------------------------------------------


def _urls(spark, d):
    return table(spark, d, "url_ledger").select("url").distinct()


_U = "WITH u AS (SELECT DISTINCT url FROM url_ledger)"


@query("url_normalize", f"{_U} SELECT url, {S.normalize('url')} AS normalized FROM u")
def url_normalize(spark, d):
    return _urls(spark, d).select("url", urls.normalize_url("url").alias("normalized"))


@query("url_branch", f"{_U} SELECT url, {S.branch('url')} AS branch_key FROM u")
def url_branch(spark, d):
    return _urls(spark, d).select("url", urls.branch_key("url").alias("branch_key"))


@query("url_identity", f"{_U} SELECT url, md5(url) AS url_hash, CAST(strlen(url) AS INT) AS url_length, sha256({S.normalize('url')}) AS page_hash FROM u")
def url_identity(spark, d):
    return _urls(spark, d).select("url", urls.identity_hash("url").alias("url_hash"), urls.identity_length("url").alias("url_length"), urls.page_hash("url").alias("page_hash"))


@query("url_host", f"{_U} SELECT url, regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1) AS netloc, {S.host_key('url')} AS host FROM u")
def url_host(spark, d):
    return _urls(spark, d).select("url", urls.netloc("url").alias("netloc"), urls.host_key("url").alias("host"))


@query("registrable_domain", r"""SELECT host, CASE WHEN regexp_matches(h, '^\d{1,3}(\.\d{1,3}){3}$') OR contains(h, ':') OR len(string_split(h, '.')) <= 2 THEN h ELSE array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') END AS domain
    FROM (SELECT host, trim(lower(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d+$', '')), '.') AS h FROM host_ledger)""")
def registrable_domain(spark, d):
    return table(spark, d, "host_ledger").select("host", urls.registrable_domain("host").alias("domain"))


@query("url_archetype", f"{_U} SELECT url, {S.archetype('url')} AS archetype FROM u")
def url_archetype(spark, d):
    return _urls(spark, d).select("url", urls.archetype("url").alias("archetype"))


@query("egress_guard", f"""{_U} SELECT url, CASE WHEN {S.scheme('url')} NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN {S.host_key('url')} = '' THEN 'missing_host' WHEN contains({S.host_key('url')}, '@') THEN 'userinfo_not_allowed'
    WHEN regexp_matches({S.host_key('url')}, ':(?:80|443)$') OR NOT contains({S.host_key('url')}, ':') THEN 'allowed' ELSE 'blocked_port' END AS reason FROM u""")
def egress_guard(spark, d):
    return _urls(spark, d).select("url", urls.egress_reason("url").alias("reason"))


@query("egress_answers")
def egress_answers(spark, d):
    """Hosts with an answer in a blocked range; host addresses are stood in for by the digests of their names."""
    h = table(spark, d, "host_ledger").select(F.lower("host").alias("host"), F.md5("host").alias("m"))
    part = lambda i: F.conv(F.substring("m", i, 2), 16, 10)
    answers = h.select("host", F.concat_ws(".", part(1), part(3), part(5), part(7)).alias("address"))
    return answers.groupBy("host").agg(F.bool_or(urls.blocked_v4(F.col("address")) | urls.blocked_v6("address")).alias("blocked"))


# --- content and HTML -----------------------------------------------------------------------

_K = S.content_type("content_type")


@query("content_policy", f"""WITH {S.PAGES} SELECT url_hash, {_K} AS kind, {S.is_text(_K)} AS is_text, {S.is_binary(_K)} AS is_binary,
    CASE WHEN {S.is_binary(_K)} THEN 'binary_content_type' WHEN content_length > 2000000 THEN 'content_length_too_large' WHEN {_K} = '' AND lower(regexp_extract(regexp_extract(string_split(url, '?')[1], '([^/]*)/*$', 1), '[^.]\\.([^.]+)$', 1)) IN ({', '.join(repr(x) for x in content.BINARY_SUFFIXES)}) THEN 'binary_url_suffix' ELSE 'read' END AS fetch_reason FROM pg""".replace("\\\\.", "\\."))
def content_policy(spark, d):
    k = content.content_type("content_type")
    return _pages(spark, d).select("url_hash", k.alias("kind"), content.is_text(k).alias("is_text"), content.is_binary(k).alias("is_binary"), content.fetch_reason("content_type", "content_length", "url").alias("fetch_reason"))


@query("storage_tiering", f"""WITH {S.PAGES} SELECT pg.url_hash, CASE WHEN t.stores AND length(coalesce(t.content, '')) > 0 THEN 'body' ELSE 'metadata_only' END AS tier, CASE WHEN t.stores THEN CAST(strlen(coalesce(t.content, '')) AS INT) ELSE 0 END AS bytes
    FROM pg JOIN (SELECT pg.url_hash, c.content, CASE WHEN {S.content_type('pg.content_type')} <> '' THEN {S.is_text(S.content_type('pg.content_type'))} ELSE instr(coalesce(c.content, ''), chr(0)) = 0 END AS stores FROM pg LEFT JOIN page_content c ON c.url_hash = pg.url_hash) t ON t.url_hash = pg.url_hash""")
def storage_tiering(spark, d):
    j = _pages(spark, d).select("url_hash", "content_type").join(table(spark, d, "page_content").select("url_hash", "content"), "url_hash", "left")
    stores_ = content.stores_text("content_type", "content")
    body = F.coalesce("content", F.lit(""))
    return j.select("url_hash", F.when(stores_ & (F.length(body) > 0), "body").otherwise("metadata_only").alias("tier"), F.when(stores_, F.octet_length(body)).otherwise(0).alias("bytes"))


def _html(spark, d):
    """Pages with the HTML that stands for them."""
    t = F.coalesce("title", F.lit(""))
    links = F.array_join(F.transform(F.coalesce("outlinks", F.array().cast("array<string>")), lambda u: F.concat(F.lit('<a href="'), u, F.lit('">'), u, F.lit("</a>"))), " ")
    return _pages(spark, d).select("url_hash", "url", "host", "title", "content_type", "content_length", F.concat(F.lit("<html><head><title>"), t, F.lit('</title></head><body><p class="lead">'), t, F.lit("</p>"), links, F.lit("</body></html>")).alias("html"))


@query("page_title", f"WITH {S.PAGES}, h AS (SELECT url_hash, {S.HTML} AS html FROM pg) SELECT url_hash, substr(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 500) AS title FROM h")
def page_title(spark, d):
    return _html(spark, d).select("url_hash", content.title("html").alias("title"))


@query("page_signals", f"WITH {S.PAGES}, h AS (SELECT url_hash, content_type, content_length, {S.HTML} AS html FROM pg) SELECT url_hash, {_K} AS kind, CASE WHEN contains({_K}, 'html') THEN substr(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 300) END AS title, coalesce(content_length, CAST(strlen(html) AS INT)) AS length FROM h")
def page_signals(spark, d):
    h = _html(spark, d)
    k = content.content_type("content_type")
    return h.select("url_hash", k.alias("kind"), F.when(k.contains("html"), content.title("html", 300)).alias("title"), F.coalesce("content_length", F.octet_length("html")).alias("length"))


@query("needs_browser", f"WITH {S.PAGES}, h AS (SELECT url_hash, {S.HTML} AS html FROM pg) SELECT url_hash, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'))) < 500 AS needs FROM h")
def needs_browser(spark, d):
    return _html(spark, d).select("url_hash", content.needs_browser("html").alias("needs"))


@query("anchors", f"WITH {S.PAGES}, n AS (SELECT url_hash, unnest(outlinks) AS u, unnest(range(len(outlinks))) AS i FROM pg WHERE outlinks IS NOT NULL) SELECT url_hash, CAST(i AS INT) AS position, {S.normalize('u')} AS link, trim(u) AS text FROM n")
def anchors(spark, d):
    return html.anchor_rows(_html(spark, d))


@query("outlinks", f"""WITH {S.PAGES}, n AS (SELECT url_hash, unnest(outlinks) AS u, unnest(range(len(outlinks))) AS i FROM pg WHERE outlinks IS NOT NULL), m AS (SELECT url_hash, {S.normalize('u')} AS link, min(i) AS i FROM n GROUP BY 1, 2)
    SELECT url_hash, list(link ORDER BY i) AS outlinks FROM m GROUP BY url_hash""")
def outlinks(spark, d):
    return html.outlinks(html.anchor_rows(_html(spark, d)))


@query("link_refs", f"WITH {S.PAGES}, n AS (SELECT url_hash, unnest(outlinks) AS u FROM pg WHERE outlinks IS NOT NULL) SELECT url_hash, {S.normalize('u')} AS link, substr(trim(u), 1, 100) AS text FROM n")
def link_refs(spark, d):
    a = html.anchor_rows(_html(spark, d))
    return a.select("url_hash", "link", F.substring("text", 1, 100).alias("text"))


@query("css_select", f"WITH {S.PAGES} SELECT url_hash, CASE WHEN trim(coalesce(title, '')) = '' THEN [] ELSE [trim(title)] END AS leads, list_filter(coalesce(outlinks, []), lambda u: u <> '') AS hrefs FROM pg")
def css_select(spark, d):
    h = _html(spark, d)
    return h.select("url_hash", html.css_column(F.col("html"), "body > p.lead").alias("leads"), html.css_column(F.col("html"), "a[href]", "href").alias("hrefs"))


@query("html_meta")
def html_meta(spark, d):
    h = _html(spark, d).withColumn("html", F.concat(F.lit('<meta name="host" content="'), "host", F.lit('"><meta property="og:url" content="'), "url", F.lit('">'), "html"))
    return h.select("url_hash", html.meta_column(F.col("html")).alias("meta"), html.body_text(F.col("html")).alias("text"))


@query("xpath_to_css", f"{_U}, x AS (SELECT url, '//a[@href=\"' || url || '\"]/b//c[@id]' AS xpath FROM u) SELECT url, trim(regexp_replace(replace(regexp_replace(regexp_replace(replace(regexp_replace(xpath, '^//', ''), '//', ' '), '\\[@([\\w-]+)=', '[\\1=', 'g'), '\\[@([\\w-]+)\\]', '[\\1]', 'g'), '/', ' > '), '\\s+', ' ', 'g')) AS css FROM x")
def xpath_to_css(spark, d):
    x = _urls(spark, d).withColumn("xpath", F.concat(F.lit('//a[@href="'), "url", F.lit('"]/b//c[@id]')))
    return x.select("url", html.xpath_to_css("xpath").alias("css"))


@query("error_category", f"SELECT last_error, {S.error_category('last_error')} AS category, count(*) AS n FROM url_ledger GROUP BY 1, 2")
def error_category(spark, d):
    return table(spark, d, "url_ledger").groupBy("last_error").agg(F.count("*").alias("n")).select("last_error", content.error_category("last_error").alias("category"), "n")


@query("redact_error", r"""SELECT url, substr(trim(regexp_replace(regexp_replace(regexp_replace(m, '\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s]+', '<redacted-url>', 'g'), '\b\S+:\S+@', '<redacted-credentials>@', 'g'), '\s+', ' ', 'g')), 1, 240) AS message FROM (SELECT DISTINCT url, 'failed  at ' || url || ' for user:pass@proxy: ' || coalesce(last_error, '') AS m FROM url_ledger)""")
def redact_error(spark, d):
    m = table(spark, d, "url_ledger").select("url", F.concat(F.lit("failed  at "), "url", F.lit(" for user:pass@proxy: "), F.coalesce("last_error", F.lit(""))).alias("m")).distinct()
    return m.select("url", content.redact_error("m").alias("message"))


# --- heads, leases, windows -----------------------------------------------------------------


@query("host_heads", f"WITH {S.SNAPSHOT}, {S.HEADS} SELECT * FROM hd")
def host_heads(spark, d):
    return _heads(spark, d)


@query("host_heads_live", f"WITH {S.SNAPSHOT}, {S.LIVE} SELECT * FROM live")
def host_heads_live(spark, d):
    return _live(spark, d)


@query("lease_host_first", f"WITH {S.SNAPSHOT}, {S.LIVE} SELECT * FROM live ORDER BY host_pending_count, latency_penalty, next_fetch_at, added_at, scheduler_score DESC, url LIMIT 32")
def lease_host_first(spark, d):
    return heads.lease_by_host(_live(spark, d), 32)


@query("lease_url_order", f"WITH {S.SNAPSHOT} SELECT url, host, physical_queue, scheduler_score, next_fetch_at, added_at, {S.penalty('latency_ewma_ms')} AS latency_penalty FROM (SELECT q.*, hs.latency_ewma_ms FROM q LEFT JOIN hs ON hs.host_key = q.host WHERE {S.RUNNABLE} AND url IN (SELECT url FROM ledger WHERE terminal_reason IS NULL)) ORDER BY scheduler_score DESC, latency_penalty, next_fetch_at, added_at, url, physical_queue LIMIT 100")
def lease_url_order(spark, d):
    s = _snap(spark, d)
    return heads.lease_by_url(s.queue, s.host_state, s.ledger, NOW, 100)


@query("head_read", f"WITH {S.SNAPSHOT}, {S.HEADS} SELECT * FROM hd WHERE runnable_at <= {NOW} ORDER BY execution_tier, runnable_url_count, latency_penalty, head_next_fetch_at, head_added_at, head_scheduler_score DESC, physical_queue, head_url LIMIT 128")
def head_read(spark, d):
    return heads.read_heads(_heads(spark, d), NOW)


@query("head_readiness", f"WITH {S.SNAPSHOT}, {S.HEADS} SELECT count(*) AS heads, CAST(sum(runnable_url_count) AS BIGINT) AS urls, CAST(coalesce(sum(runnable_url_count) FILTER (runnable_at <= {NOW}), 0) AS BIGINT) AS runnable_urls, count(*) FILTER (runnable_at <= {NOW}) AS runnable_heads, min(runnable_at - {NOW}) FILTER (runnable_at > {NOW}) AS next_delay FROM hd")
def head_readiness(spark, d):
    now = F.col("runnable_at") <= NOW
    return _heads(spark, d).agg(F.count("*").alias("heads"), F.sum("runnable_url_count").alias("urls"), F.sum(F.when(now, F.col("runnable_url_count")).otherwise(0)).alias("runnable_urls"), F.count(F.when(now, 1)).alias("runnable_heads"), F.min(F.when(~now, F.col("runnable_at") - NOW)).alias("next_delay"))


@query("overcrowded", f"WITH {S.SNAPSHOT} SELECT url, host, branch_key, physical_queue, CAST(hr AS INT) AS host_rank, CAST(br AS INT) AS branch_rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY scheduler_score DESC, next_fetch_at, added_at, url, physical_queue) AS hr, row_number() OVER (PARTITION BY host, branch_key ORDER BY scheduler_score DESC, next_fetch_at, added_at, url, physical_queue) AS br FROM q) WHERE hr > 20 OR br > 5")
def overcrowded(spark, d):
    return heads.overcrowded(_snap(spark, d).queue, 20, 5)


@query("quarantine_restore", f"WITH {S.SNAPSHOT} SELECT url, host, physical_queue FROM (SELECT blocked.*, row_number() OVER (PARTITION BY host ORDER BY next_fetch_at, added_at, url, physical_queue) AS rn FROM blocked) WHERE rn <= 2 ORDER BY scheduler_score DESC, next_fetch_at, added_at, url, physical_queue LIMIT 200")
def quarantine_restore(spark, d):
    order = ["next_fetch_at", "added_at", "url", "physical_queue"]
    return heads.top_per_host(_snap(spark, d).blocked, order, 2).orderBy(F.desc("scheduler_score"), *order).limit(200).select("url", "host", "physical_queue")


@query("quarantine_promote", f"WITH {S.SNAPSHOT} SELECT url, host, physical_queue, consecutive_failures FROM (SELECT b.*, hs.consecutive_failures, row_number() OVER (PARTITION BY b.host ORDER BY hs.consecutive_failures, next_fetch_at, added_at, url, physical_queue) AS rn FROM blocked b JOIN hs ON hs.host_key = b.host WHERE hs.consecutive_failures <= 5) WHERE rn <= 1")
def quarantine_promote(spark, d):
    s = _snap(spark, d)
    rows = s.blocked.join(s.host_state.select(F.col("host_key").alias("host"), "consecutive_failures"), "host").where("consecutive_failures <= 5")
    return heads.top_per_host(rows, ["consecutive_failures", "next_fetch_at", "added_at", "url", "physical_queue"], 1).select("url", "host", "physical_queue", "consecutive_failures")


@query("head_repair_scan", f"WITH {S.SNAPSHOT}, {S.LIVE} SELECT DISTINCT host, physical_queue FROM q WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.host = q.host AND live.physical_queue = q.physical_queue)")
def head_repair_scan(spark, d):
    s = _snap(spark, d)
    return heads.repair_scan(s.queue, heads.live_heads(s.queue, s.host_state, NOW).withColumnRenamed("url", "head_url"))[1].select("host", "physical_queue")


# --- reports ----------------------------------------------------------------------------------


@query("page_totals", f"WITH {S.PAGES} SELECT count(*) AS pages, count(DISTINCT host) AS hosts, min(crawled_at) AS first_crawl, max(crawled_at) AS last_crawl, CAST(sum(content_length) AS BIGINT) AS content_length, CAST(sum(stored_content_bytes) AS BIGINT) AS stored_content_bytes FROM pg")
def page_totals(spark, d):
    return reports.page_totals(_pages(spark, d))


@query("storage_tiers", f"WITH {S.PAGES} SELECT storage_tier, storage_reason, count(*) AS pages, CAST(sum(coalesce(content_length, 0)) AS BIGINT) AS content_length, CAST(sum(stored_content_bytes) AS BIGINT) AS stored_content_bytes, CAST(sum(outlink_count) AS BIGINT) AS outlink_count, CAST(sum(stored_outlink_count) AS BIGINT) AS stored_outlink_count, count(*) FILTER (content_truncated) AS truncated FROM pg GROUP BY 1, 2")
def storage_tiers(spark, d):
    return reports.storage_tiers(_pages(spark, d))


@query("queue_counts", f"WITH {S.QUEUE}, n AS (SELECT unnest(['runnable', 'scheduled', 'refresh']) AS physical_queue) SELECT n.physical_queue, count(q.url) AS n FROM n LEFT JOIN q USING (physical_queue) GROUP BY 1")
def queue_counts(spark, d):
    return reports.queue_counts(_snap(spark, d))


@query("intent_counts", f"WITH {S.SNAPSHOT}, n AS (SELECT unnest(['explore', 'refresh', 'retry']) AS intent) SELECT n.intent, count(l.url) AS n FROM n LEFT JOIN (SELECT * FROM ledger WHERE url IN (SELECT url FROM q UNION SELECT url FROM leases)) l ON l.current_intent = n.intent GROUP BY 1")
def intent_counts(spark, d):
    return reports.intent_counts(_snap(spark, d))


_STATES = f"WITH {S.SNAPSHOT}, st AS (SELECT CASE WHEN l.terminal_reason IS NOT NULL THEN 'terminal' WHEN p.state IS NOT NULL THEN p.state WHEN l.last_success_at IS NOT NULL THEN 'done' ELSE 'discovered' END AS state FROM ledger l LEFT JOIN (SELECT url, physical_queue AS state FROM pend UNION ALL SELECT url, 'blocked' FROM blocked UNION ALL SELECT url, 'leased' FROM leases) p ON p.url = l.url)"


@query("durable_state_counts", f"{_STATES} SELECT state, count(*) AS n FROM st GROUP BY state")
def durable_state_counts(spark, d):
    return reports.durable_state_counts(_snap(spark, d))


@query("status_counts", f"{_STATES} SELECT count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'terminal') AS terminal, count(*) FILTER (state IN ('runnable', 'scheduled', 'refresh')) AS pending, count(*) AS total FROM st")
def status_counts(spark, d):
    c = reports.durable_state_counts(_snap(spark, d))
    of = lambda *s: F.coalesce(F.sum(F.when(F.col("state").isin(*s), F.col("n"))), F.lit(0)).cast("long")
    return c.agg(of("leased").alias("leased"), of("done").alias("done"), of("terminal").alias("terminal"), of(*frontier.QUEUES).alias("pending"), F.sum("n").alias("total"))


@query("readiness", f"""WITH {S.SNAPSHOT}, j AS (SELECT p.*, hs.next_request_at, hs.backoff_until FROM pend p LEFT JOIN hs ON hs.host_key = p.host)
    SELECT count(*) AS pending, count(DISTINCT host) AS pending_hosts, count(*) FILTER {S.RUNNABLE} AS runnable, count(DISTINCT host) FILTER {S.RUNNABLE} AS runnable_hosts, count(*) FILTER (next_fetch_at > {NOW}) AS scheduled,
    count(*) FILTER (next_fetch_at <= {NOW} AND coalesce(next_request_at, 0) > {NOW} AND coalesce(backoff_until, 0) <= {NOW}) AS next_request_wait, count(*) FILTER (next_fetch_at <= {NOW} AND coalesce(backoff_until, 0) > {NOW}) AS backoff_wait,
    min(greatest(next_fetch_at, coalesce(next_request_at, 0), coalesce(backoff_until, 0)) - {NOW}) FILTER (greatest(next_fetch_at, coalesce(next_request_at, 0), coalesce(backoff_until, 0)) > {NOW}) AS next_runnable_delay FROM j""")
def readiness(spark, d):
    return reports.readiness(_snap(spark, d))


@query("error_breakdown", f"WITH {S.SNAPSHOT} SELECT category, count(*) AS n FROM (SELECT {S.error_category('last_error')} AS category FROM ledger WHERE last_error IS NOT NULL AND (terminal_reason IS NOT NULL OR url IN (SELECT url FROM q))) WHERE category IS NOT NULL GROUP BY 1")
def error_breakdown(spark, d):
    return reports.error_breakdown(_snap(spark, d))


@query("top_pending_hosts", f"WITH {S.SNAPSHOT} SELECT host, count(*) AS n FROM pend GROUP BY host ORDER BY n DESC, host LIMIT 10")
def top_pending_hosts(spark, d):
    return reports.top_hosts(_snap(spark, d).pending)


@query("top_error_hosts", f"WITH {S.SNAPSHOT} SELECT host, count(*) AS n FROM ledger WHERE host IS NOT NULL AND last_error IS NOT NULL AND (terminal_reason IS NOT NULL OR url IN (SELECT url FROM q)) GROUP BY host ORDER BY n DESC, host LIMIT 10")
def top_error_hosts(spark, d):
    s = _snap(spark, d)
    queued = s.queue.select("url").distinct().withColumn("queued", F.lit(True))
    return reports.top_hosts(s.ledger.join(queued, "url", "left").where("last_error IS NOT NULL AND (terminal_reason IS NOT NULL OR queued)"))


@query("top_page_hosts", f"WITH {S.PAGES} SELECT host, count(*) AS n FROM pg GROUP BY host ORDER BY n DESC, host LIMIT 10")
def top_page_hosts(spark, d):
    return reports.top_hosts(_pages(spark, d))


@query("top_blocked_hosts", f"""WITH {S.SNAPSHOT}, b AS (SELECT host, false AS quarantined FROM pend UNION ALL SELECT host, true FROM blocked), j AS (SELECT b.*, greatest(coalesce(backoff_until, 0) - {NOW}, 0) AS bw, greatest(coalesce(next_request_at, 0) - {NOW}, 0) AS rw FROM b LEFT JOIN hs ON hs.host_key = b.host),
    p AS (SELECT host, count(*) FILTER (quarantined) AS quarantine, count(*) FILTER (NOT quarantined AND bw > 0) AS backoff, count(*) FILTER (NOT quarantined AND bw <= 0 AND rw > 0) AS next_request, max(bw) AS backoff_wait, max(rw) AS request_wait, count(*) AS urls FROM j GROUP BY host)
    SELECT *, CASE WHEN quarantine > 0 THEN 'quarantine' WHEN backoff > 0 THEN 'host_backoff' ELSE 'next_request' END AS reason FROM p WHERE quarantine > 0 OR backoff > 0 OR next_request > 0 ORDER BY quarantine DESC, backoff DESC, backoff_wait DESC, urls DESC, host LIMIT 10""")
def top_blocked_hosts(spark, d):
    return reports.top_blocked_hosts(_snap(spark, d))


_SLOW = f"""WITH {S.SNAPSHOT}, c AS (SELECT host, count(*) FILTER (physical_queue = 'runnable') AS runnable, count(*) FILTER (physical_queue = 'scheduled') AS scheduled, count(*) FILTER (physical_queue = 'refresh') AS refresh, count(*) AS urls FROM q GROUP BY host),
    slow AS (SELECT host, runnable, scheduled, refresh, urls, round(latency_ewma_ms, 1) AS ewma_ms, round(latency_last_ms, 1) AS last_ms, latency_sample_count, consecutive_failures, CASE WHEN coalesce(consecutive_failures, 0) > 0 THEN 1 WHEN latency_ewma_ms > 0 AND latency_ewma_ms <= 150 THEN 2 ELSE 1 END AS budget FROM hs JOIN c ON c.host = hs.host_key WHERE latency_ewma_ms > 0 ORDER BY ewma_ms DESC, urls DESC, host LIMIT 10)"""


@query("top_slow_hosts", f"{_SLOW} SELECT * FROM slow")
def top_slow_hosts(spark, d):
    return reports.top_slow_hosts(_snap(spark, d))


@query("budget_summary", f"{_SLOW} SELECT count(*) AS observed, count(*) FILTER (budget > 1) AS eligible, count(*) FILTER (consecutive_failures > 0) AS failing, max(budget) AS max_budget FROM slow")
def budget_summary(spark, d):
    return reports.budget_summary(reports.top_slow_hosts(_snap(spark, d)))


@query("timing_summary", "SELECT event_type AS stage, count(*) AS n, round(avg(value), 4) AS avg_ms, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, max(value) AS max_ms FROM events WHERE value IS NOT NULL GROUP BY 1")
def timing_summary(spark, d):
    return reports.timing_summary(table(spark, d, "events"), "event_type", "value")


@query("telemetry_counts", f"WITH {S.PAGES} SELECT label, value, count(*) AS n FROM (SELECT unnest(['status', 'kind', 'tier', 'truncated']) AS label, unnest([coalesce(CAST(status AS VARCHAR), 'none'), {_K}, storage_tier, CAST(content_truncated AS VARCHAR)]) AS value FROM pg) GROUP BY 1, 2")
def telemetry_counts(spark, d):
    p = _pages(spark, d).select(F.coalesce(F.col("status").cast("string"), F.lit("none")).alias("status"), content.content_type("content_type").alias("kind"), F.col("storage_tier").alias("tier"), F.col("content_truncated").cast("string").alias("truncated"))
    return p.unpivot([], ["status", "kind", "tier", "truncated"], "label", "value").groupBy("label", "value").agg(F.count("*").alias("n"))


# --- integrity ----------------------------------------------------------------------------------


@query("inv_dup_membership", f"WITH {S.SNAPSHOT} SELECT url, count(*) AS n, string_agg(place, ',' ORDER BY place) AS places FROM member GROUP BY url HAVING count(*) > 1")
def inv_dup_membership(spark, d):
    return invariants.duplicate_memberships(_snap(spark, d))


@query("inv_terminal", f"WITH {S.SNAPSHOT} SELECT m.url, m.place, l.terminal_reason FROM member m JOIN ledger l ON l.url = m.url WHERE l.terminal_reason IS NOT NULL")
def inv_terminal(spark, d):
    return invariants.terminal_memberships(_snap(spark, d))


@query("inv_expired", f"WITH {S.SNAPSHOT} SELECT url, host, physical_queue, lease_expires_at FROM leases WHERE lease_expires_at < {NOW}")
def inv_expired(spark, d):
    return invariants.expired_leases(_snap(spark, d)).drop("lease_token")


@query("inv_orphan_heads", f"WITH {S.SNAPSHOT}, {S.HEADS} SELECT head_url, physical_queue, host FROM hd WHERE NOT EXISTS (SELECT 1 FROM pend WHERE pend.url = hd.head_url AND pend.physical_queue = hd.physical_queue)")
def inv_orphan_heads(spark, d):
    """Heads of the whole queue whose URL is no longer pending."""
    s = _snap(spark, d)
    return heads.repair_scan(s.pending, heads.host_heads(s.queue, s.host_state, s.host_ledger, NOW))[0].select("head_url", "physical_queue", "host")


@query("inv_head_mismatch", f"WITH {S.SNAPSHOT}, {S.HEADS} SELECT hd.head_url, hd.physical_queue, hd.host, {S.host_key('hd.head_url')} AS url_host FROM hd WHERE hd.host <> {S.host_key('hd.head_url')}")
def inv_head_mismatch(spark, d):
    h = _heads(spark, d).withColumn("url_host", urls.host_key("head_url"))
    return h.where("host <> url_host").select("head_url", "physical_queue", "host", "url_host")


@query("inv_hash_missing", f"WITH {S.LEDGER} SELECT url, url_hash, url_length FROM ledger WHERE url_hash IS NULL OR url_hash = '' OR url_length IS NULL OR coalesce(url_identity_version, 0) <> 1")
def inv_hash_missing(spark, d):
    return invariants.missing_identity(_snap(spark, d).ledger).select("url", "url_hash", "url_length")


@query("inv_hash_mismatch", f"WITH {S.LEDGER} SELECT url, url_hash FROM ledger WHERE url_hash IS NOT NULL AND url_hash <> '' AND url_hash <> md5(url)")
def inv_hash_mismatch(spark, d):
    return invariants.hash_mismatches(_snap(spark, d).ledger).select("url", "url_hash")


@query("inv_hash_dup", f"WITH {S.LEDGER} SELECT url_hash, count(*) AS n, list_slice(list(url ORDER BY url), 1, 3) AS urls FROM ledger WHERE url_hash IS NOT NULL AND url_hash <> '' GROUP BY url_hash HAVING count(*) > 1")
def inv_hash_dup(spark, d):
    return invariants.duplicate_hashes(_snap(spark, d).ledger)


@query("inv_len_mismatch", f"WITH {S.LEDGER} SELECT url, url_length FROM ledger WHERE url_length IS NOT NULL AND url_length <> strlen(url)")
def inv_len_mismatch(spark, d):
    return invariants.length_mismatches(_snap(spark, d).ledger).select("url", "url_length")


@query("inv_too_long", f"WITH {S.SNAPSHOT} SELECT url, place FROM member WHERE strlen(url) > 8192")
def inv_too_long(spark, d):
    return invariants.too_long(_snap(spark, d))


# --- discovery --------------------------------------------------------------------------------


def _scored(spark, d):
    seeds = table(spark, d, "url_ledger").where("source_url IS NULL AND host IS NOT NULL").select(F.lower("host").alias("host")).distinct()
    context = discovery.host_contexts(table(spark, d, "host_ledger").withColumn("host", F.lower("host")), frontier.host_states(table(spark, d, "host_state")))
    # The tables hold no meta robots; pages with an error status stand for those that say nofollow.
    pages = _pages(spark, d).withColumn("meta_robots", F.when(F.col("status") >= 400, "noindex, NoFollow"))
    return discovery.scored_links(discovery.page_links(pages), seeds, context)


_CONTROL = discovery.control(S.PENDING, S.TARGET)


@query("discovery_value", f"WITH {S.LINKS} SELECT page, url, archetype, CAST(value AS INT) AS value FROM scored")
def discovery_value(spark, d):
    return _scored(spark, d).select("page", "url", "archetype", F.col("value").cast("int").alias("value"))


@query("parent_archetype", f"WITH {S.PAGES} SELECT url_hash, {S.PARENT} AS parent_archetype FROM pg")
def parent_archetype(spark, d):
    return _pages(spark, d).select("url_hash", discovery.parent_archetype().alias("parent_archetype"))


@query("admission_control", "SELECT pending, mode, CAST(least_value AS DOUBLE) AS least_value, per_page, per_target_host, new_external_hosts FROM (VALUES (0, 'expand', 0.5, 200, 8, 8), (300000, 'balanced', 0.8, 160, 6, 5), (600000, 'reduce', 1.0, 80, 4, 2), (900000, 'drain', 1.15, 40, 2, 1)) t(pending, mode, least_value, per_page, per_target_host, new_external_hosts)")
def admission_control(spark, d):
    rows = [(p, c.mode, c.least_value, c.per_page, c.per_target_host, c.new_external_hosts) for p in (0, 300000, 600000, 900000) for c in [discovery.control(p, S.TARGET)]]
    return spark.createDataFrame(rows, "pending int, mode string, least_value double, per_page int, per_target_host int, new_external_hosts int")


@query("admission_decision", f"WITH {S.LINKS} SELECT page, url, reason FROM decided")
def admission_decision(spark, d):
    return discovery.decided_links(_scored(spark, d), _CONTROL).select("page", "url", "reason")


@query("admission_caps", f"WITH {S.LINKS} SELECT page, url, CAST(r AS INT) AS r, outcome FROM capped")
def admission_caps(spark, d):
    return discovery.capped_links(discovery.decided_links(_scored(spark, d), _CONTROL), _CONTROL).select("page", "url", "r", "outcome")


@query("admission_counts", f"WITH {S.LINKS} SELECT reason, count(*) AS n FROM decided WHERE reason <> 'candidate' GROUP BY 1 UNION ALL SELECT outcome, count(*) FROM capped GROUP BY 1 UNION ALL SELECT 'external_generic', count(*) FROM capped WHERE outcome = 'admitted' AND archetype = 'generic_page' AND host <> '' AND host <> parent_host AND NOT is_seed HAVING count(*) > 0")
def admission_counts(spark, d):
    decided = materialize(discovery.decided_links(_scored(spark, d), _CONTROL), "decided")
    return discovery.admission_counts(decided, discovery.capped_links(decided, _CONTROL))


@query("admission_summary", f"WITH {S.LINKS}, a AS (SELECT count(*) AS extracted FROM decided), b AS (SELECT count(*) FILTER (outcome = 'admitted') AS admitted, count(*) FILTER (outcome = 'admitted' AND archetype = 'generic_page' AND host <> '' AND host <> parent_host AND NOT is_seed) AS external_generic FROM capped) SELECT extracted, admitted, extracted - admitted AS rejected, external_generic, round(CAST(admitted AS DOUBLE) / extracted, 4) AS ratio FROM a, b")
def admission_summary(spark, d):
    decided = materialize(discovery.decided_links(_scored(spark, d), _CONTROL), "decided")
    return discovery.admission_summary(discovery.admission_counts(decided, discovery.capped_links(decided, _CONTROL)))


@query("parent_context", f"WITH {S.LINKS} SELECT DISTINCT page, CASE WHEN nofollow THEN 'nofollow' WHEN parent_archetype IN ('registry_listing', 'redirect_hub') THEN 'low_signal' ELSE 'generic' END AS context FROM links")
def parent_context(spark, d):
    return _scored(spark, d).select("page", discovery.parent_context().alias("context")).distinct()


@query("admission_scoped", f"WITH {S.LINKS} SELECT CASE WHEN regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1) <> regexp_extract(parent_url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1) THEN 'scope_filtered' ELSE reason END AS reason, count(*) AS n FROM decided GROUP BY 1")
def admission_scoped(spark, d):
    """Reasons where a crawl keeps to the hosts it started at."""
    return discovery.decided_links(_scored(spark, d), _CONTROL, same_host=True).groupBy("reason").agg(F.count("*").alias("n"))


@query("page_outlinks", f"WITH {S.LINKS} SELECT pages_.page, pages_.outlink_count, coalesce(a.outlinks, []) AS outlinks FROM (SELECT page, count(*) AS outlink_count FROM links GROUP BY page) pages_ LEFT JOIN (SELECT page, list(url ORDER BY r) AS outlinks FROM capped WHERE outcome = 'admitted' GROUP BY page) a ON a.page = pages_.page")
def page_outlinks(spark, d):
    decided = materialize(discovery.decided_links(_scored(spark, d), _CONTROL), "decided")
    admitted = discovery.capped_links(decided, _CONTROL).where("outcome = 'admitted'")
    lists = admitted.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("r", "url"))).alias("a")).select("page", F.transform("a", lambda s: s["url"]).alias("outlinks"))
    return decided.groupBy("page").agg(F.count("*").alias("outlink_count")).join(lists, "page", "left").select("page", "outlink_count", F.coalesce("outlinks", F.array().cast("array<string>")).alias("outlinks"))


# --- transitions ----------------------------------------------------------------------------------


def _tasks(spark, d):
    """Outlinks of all pages as tasks, in an order that is the same everywhere."""
    l = _pages(spark, d).where("outlinks IS NOT NULL").select("url_hash", F.col("url").alias("source_url"), "crawled_at", F.posexplode("outlinks").alias("i", "url"))
    return l.select(F.concat("url_hash", F.lit(":"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("seq"), "url", F.lit(0.8).alias("value"), "source_url", F.col("crawled_at").alias("added_at"), F.col("crawled_at").alias("next_fetch_at"), F.lit("explore").alias("intent"))


_TASKS = f"""{S.PAGES}, t0 AS (SELECT url_hash, url AS source_url, crawled_at, unnest(outlinks) AS u, unnest(range(len(outlinks))) AS i FROM pg WHERE outlinks IS NOT NULL), t1 AS (SELECT url_hash || ':' || lpad(CAST(i AS VARCHAR), 6, '0') AS seq, {S.normalize('u')} AS url, source_url, crawled_at FROM t0),
    tasks AS (SELECT url, 0.8 AS value, arg_min(source_url, seq) AS source_url, 'explore' AS intent, min(crawled_at) AS added_at, min(crawled_at) AS next_fetch_at FROM t1 WHERE strlen(url) <= 8192 GROUP BY url)"""


@query("prepare_tasks", f"WITH {_TASKS} SELECT url, CAST(value AS DOUBLE) AS value, source_url, intent, added_at, next_fetch_at FROM tasks")
def prepare_tasks(spark, d):
    return transitions.prepare_tasks(_tasks(spark, d))


_UPSERT = f"""WITH {_TASKS}, {S.LEDGER}, m AS (SELECT t.url, l.url IS NULL AS is_new, l.terminal_reason IS NULL AND l.last_success_at IS NULL AS open, l.discovery_value AS o_value, l.source_url AS o_source, l.added_at AS o_added, l.next_fetch_at AS o_next, l.current_intent AS o_intent,
      CASE WHEN l.url IS NULL THEN t.value ELSE greatest(l.discovery_value, t.value) END AS discovery_value, coalesce(l.source_url, t.source_url) AS source_url, CASE WHEN l.url IS NULL THEN t.added_at ELSE least(l.added_at, t.added_at) END AS added_at, CASE WHEN l.url IS NULL THEN t.next_fetch_at ELSE least(l.next_fetch_at, t.next_fetch_at) END AS next_fetch_at, coalesce(t.intent, l.current_intent) AS current_intent FROM tasks t LEFT JOIN ledger l ON l.url = t.url),
    up AS (SELECT url, CASE WHEN is_new THEN 'inserted' ELSE 'updated' END AS change, CAST(discovery_value AS DOUBLE) AS discovery_value, source_url, added_at, next_fetch_at, current_intent FROM m WHERE is_new OR (open AND (discovery_value IS DISTINCT FROM o_value OR source_url IS DISTINCT FROM o_source OR added_at IS DISTINCT FROM o_added OR next_fetch_at IS DISTINCT FROM o_next OR current_intent IS DISTINCT FROM o_intent)))"""


def _changes(spark, d):
    return transitions.ledger_upsert(_snap(spark, d).ledger, transitions.prepare_tasks(_tasks(spark, d)))


@query("ledger_upsert", f"{_UPSERT} SELECT * FROM up")
def ledger_upsert(spark, d):
    return _changes(spark, d)


@query("new_urls_per_host", f"{_UPSERT} SELECT {S.host_key('url')} AS host, count(*) FILTER (change = 'inserted') AS n FROM up GROUP BY 1")
def new_urls_per_host(spark, d):
    return transitions.new_urls_per_host(_changes(spark, d))


@query("is_seen", f"WITH {S.LINKS} SELECT arch.url, EXISTS (SELECT 1 FROM url_ledger l WHERE l.url = arch.url) AS seen FROM arch")
def is_seen(spark, d):
    known = table(spark, d, "url_ledger").select("url").distinct().withColumn("seen", F.lit(True))
    return discovery.page_links(_pages(spark, d)).select("url").distinct().join(known, "url", "left").select("url", F.coalesce("seen", F.lit(False)).alias("seen"))


@query("admission_candidates", f"WITH {S.SNAPSHOT} SELECT url, host, discovery_value, next_fetch_at, added_at FROM ledger WHERE terminal_reason IS NULL AND last_success_at IS NULL AND url NOT IN (SELECT url FROM q) ORDER BY discovery_value DESC, next_fetch_at, added_at, url LIMIT 500")
def admission_candidates(spark, d):
    return transitions.admission_candidates(_snap(spark, d), 500)


@query("retry_policy", f"""WITH {S.LEDGER} SELECT url, CASE WHEN fail_streak <= 1 THEN 30.0 ELSE least(1800.0, 30.0 * pow(2.0, least(fail_streak, 40) - 1)) END AS backoff,
    CASE WHEN fail_streak <= 0 THEN discovery_value ELSE greatest(0.25, floor(discovery_value * pow(0.6, fail_streak) * 100 + 0.500000001) / 100) END AS score FROM ledger""")
def retry_policy(spark, d):
    return _snap(spark, d).ledger.select("url", policy.retry_backoff("fail_streak").alias("backoff"), policy.retry_score("discovery_value", "fail_streak").alias("score"))


@query("host_backoff", f"WITH {S.STATE} SELECT host_key, CASE WHEN consecutive_failures <= 0 THEN 0.0 ELSE least(600.0, 30.0 * pow(2.0, least(consecutive_failures, 40) - 1)) END AS backoff FROM hs")
def host_backoff(spark, d):
    return frontier.host_states(table(spark, d, "host_state")).select("host_key", policy.host_backoff("consecutive_failures").alias("backoff"))


@query("outcome_map", f"WITH {S.PAGES} SELECT url_hash, CASE WHEN status IN (401, 403) THEN 'terminal' WHEN status BETWEEN 500 AND 599 THEN 'retry' WHEN status BETWEEN 400 AND 499 THEN 'done' WHEN status IS NULL THEN 'retry' ELSE 'done' END AS outcome FROM pg")
def outcome_map(spark, d):
    return _pages(spark, d).select("url_hash", policy.outcome("status", F.lit(None).cast("string")).alias("outcome"))


@query("recover_leases", f"WITH {S.SNAPSHOT} SELECT l.url, l.host, l.physical_queue, CASE WHEN g.fail_streak <= 0 THEN g.discovery_value ELSE greatest(0.25, floor(g.discovery_value * pow(0.6, g.fail_streak) * 100 + 0.500000001) / 100) END AS scheduler_score, g.next_fetch_at, g.added_at, {S.branch('l.url')} AS branch_key FROM leases l JOIN ledger g ON g.url = l.url WHERE l.lease_expires_at <= {NOW}")
def recover_leases(spark, d):
    return transitions.recover_leases(_snap(spark, d))


@query("mark_done", f"WITH {S.SNAPSHOT} SELECT url, CAST({NOW} AS DOUBLE) AS next_fetch_at, CAST(NULL AS VARCHAR) AS current_intent, CAST({NOW} AS DOUBLE) AS last_success_at, 0 AS fail_streak, CAST(NULL AS VARCHAR) AS last_error FROM ledger WHERE url IN (SELECT url FROM leases)")
def mark_done(spark, d):
    return transitions.mark_done(_snap(spark, d))


@query("mark_failed", f"""WITH {S.SNAPSHOT}, f AS (SELECT DISTINCT g.url, g.last_error AS error, coalesce({S.error_category('g.last_error')} IN ('http_5xx', 'timeout', 'connection_error'), false) AS retryable FROM ledger g WHERE g.last_error IS NOT NULL)
    SELECT g.url, g.fail_streak + 1 AS fail_streak, CASE WHEN f.retryable THEN greatest(0.25, floor(g.discovery_value * pow(0.6, g.fail_streak + 1) * 100 + 0.500000001) / 100) ELSE g.discovery_value END AS scheduler_score,
    CASE WHEN f.retryable THEN {NOW} + CASE WHEN g.fail_streak + 1 <= 1 THEN 30.0 ELSE least(1800.0, 30.0 * pow(2.0, least(g.fail_streak + 1, 40) - 1)) END ELSE {NOW} END AS next_fetch_at, CASE WHEN f.retryable THEN 'retry' END AS current_intent, CASE WHEN NOT f.retryable THEN coalesce(f.error, 'failed') END AS terminal_reason, CASE WHEN f.retryable THEN 'scheduled' END AS physical_queue
    FROM ledger g JOIN f ON f.url = g.url WHERE g.terminal_reason IS NULL""")
def mark_failed(spark, d):
    s = _snap(spark, d)
    f = s.ledger.where("last_error IS NOT NULL").select("url", F.col("last_error").alias("error"), F.coalesce(content.error_category("last_error").isin("http_5xx", "timeout", "connection_error"), F.lit(False)).alias("retryable"))
    return transitions.mark_failed(s, f)


@query("quarantine_rebalance", f"WITH {S.SNAPSHOT} SELECT url, host, physical_queue FROM q WHERE host IN (SELECT host_key FROM hs WHERE backoff_until > {NOW})")
def quarantine_rebalance(spark, d):
    return transitions.rebalance(_snap(spark, d)).select("url", "host", "physical_queue")


@query("quarantine_retire", f"WITH {S.SNAPSHOT} SELECT b.url, b.host, b.physical_queue, coalesce(l.terminal_reason, l.last_error, 'retry_quarantine_retired') AS terminal_reason FROM blocked b JOIN hs ON hs.host_key = b.host JOIN ledger l ON l.url = b.url WHERE hs.consecutive_failures >= 3 AND b.quarantined_at <= {NOW} - 60 ORDER BY hs.consecutive_failures DESC, b.quarantined_at, b.added_at, b.url, b.physical_queue LIMIT 256")
def quarantine_retire(spark, d):
    return transitions.retire_blocked(_snap(spark, d), 3, 60.0, 256)


@query("replace_membership", f"""WITH {S.SNAPSHOT} SELECT url, host, physical_queue FROM q WHERE url NOT IN (SELECT url FROM leases) UNION ALL SELECT url, host, physical_queue FROM leases""")
def replace_membership(spark, d):
    s = _snap(spark, d)
    incoming = s.leases.select("url", "host", "physical_queue", F.lit(1.0).alias("scheduler_score"), F.lit(NOW).alias("next_fetch_at"), F.lit(NOW).alias("added_at"), urls.branch_key("url").alias("branch_key"))
    return transitions.replace_membership(s.queue, incoming).select("url", "host", "physical_queue")


@query("stale_refresh", f"WITH {S.SNAPSHOT}, {S.PAGES}, c AS (SELECT url, max(crawled_at) AS crawled_at FROM pg GROUP BY url) SELECT l.url, l.host, c.crawled_at FROM ledger l JOIN c ON c.url = l.url WHERE l.terminal_reason IS NULL ORDER BY c.crawled_at, l.url LIMIT 300")
def stale_refresh(spark, d):
    return transitions.stale_refresh(_snap(spark, d), _pages(spark, d), 300)


@query("promote_heads", f"WITH {S.SNAPSHOT} SELECT host, url, scheduler_score, added_at FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY scheduler_score DESC, added_at, url) AS rn FROM pend WHERE physical_queue = 'scheduled' AND next_fetch_at <= {NOW} AND host NOT IN (SELECT host FROM pend WHERE physical_queue = 'runnable')) WHERE rn = 1 ORDER BY scheduler_score DESC, added_at, url LIMIT 100")
def promote_heads(spark, d):
    return transitions.promote_heads(_snap(spark, d), 100)


@query("repair_terminal", f"WITH {S.SNAPSHOT} SELECT CASE WHEN contains(m.place, ':blocked') THEN 'blocked' WHEN contains(m.place, ':leased') THEN 'leased' ELSE 'queue' END AS kind, count(*) AS removed FROM member m JOIN ledger l ON l.url = m.url WHERE l.terminal_reason IS NOT NULL GROUP BY 1")
def repair_terminal(spark, d):
    t = invariants.terminal_memberships(_snap(spark, d))
    kind = F.when(F.col("place").contains(":blocked"), "blocked").when(F.col("place").contains(":leased"), "leased").otherwise("queue")
    return t.groupBy(kind.alias("kind")).agg(F.count("*").alias("removed"))


# --- hosts and links ----------------------------------------------------------------------------


@query("latency_ewma", """WITH e AS (SELECT user_id, list(value * 10 ORDER BY ts, event_id) AS vs FROM events WHERE event_type <> 'error' AND value > 0 GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS host, len(vs) AS samples, round(list_reduce(vs, lambda a, v: CASE WHEN a <= 0 THEN v ELSE 0.8 * a + 0.2 * v END), 6) AS ewma_ms, vs[-1] AS last_ms FROM e""")
def latency_ewma(spark, d):
    e = table(spark, d, "events").where("event_type <> 'error'").select(F.col("user_id").cast("string").alias("host_"), "ts", "event_id", (F.col("value") * 10).alias("ms"))
    return hosts.latency_ewma(e, "host_", ["ts", "event_id"], "ms").withColumn("ewma_ms", F.round("ewma_ms", 6))


_EV = "e AS (SELECT CAST(user_id AS VARCHAR) AS host, epoch(ts) AS t, event_id AS id, event_type = 'error' AS failed FROM events)"


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("host_"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_"), F.col("event_id").alias("id_"), (F.col("event_type") == "error").alias("failed_"))


@query("host_state_fold", f"""WITH {_EV}, a AS (SELECT host, count(*) FILTER (NOT failed) AS successes, count(*) FILTER (failed) AS failures, max(t) FILTER (NOT failed) AS last_success_at, max(t) FILTER (failed) AS last_failure_at FROM e GROUP BY host),
    l AS (SELECT host, max((t, id)) AS k FROM e WHERE NOT failed GROUP BY host), s AS (SELECT e.host, t, row_number() OVER (PARTITION BY e.host ORDER BY t, id) AS nth FROM e LEFT JOIN l ON l.host = e.host WHERE failed AND (l.k IS NULL OR (t, id) > l.k)),
    f AS (SELECT host, max(nth) AS c, max(t + least(600.0, 30.0 * pow(2.0, least(nth, 40) - 1))) AS b FROM s GROUP BY host)
    SELECT a.*, CAST(coalesce(f.c, 0) AS INT) AS consecutive_failures, coalesce(f.b, 0.0) AS backoff_until FROM a LEFT JOIN f ON f.host = a.host""")
def host_state_fold(spark, d):
    return hosts.host_outcomes(_events(spark, d), "host_", "at_", "id_", "failed_")


@query("pacing_slots", f"WITH {_EV}, n AS (SELECT host, id, t, row_number() OVER (PARTITION BY host ORDER BY t, id) AS n FROM e), s AS (SELECT host, id, t, max(t - n * 600.0) OVER (PARTITION BY host ORDER BY t, id ROWS UNBOUNDED PRECEDING) + n * 600.0 AS slot FROM n) SELECT host, id, round(slot, 3) AS slot, round(slot - t, 3) AS wait FROM s")
def pacing_slots(spark, d):
    return hosts.pacing_slots(_events(spark, d), "host_", "at_", "id_", 600.0)


@query("host_ledger", f"WITH {S.LEDGER} SELECT host, count(*) AS known_urls, count(last_success_at) AS succeeded, count(last_error) AS failed, min(added_at) AS first_seen_at, max(greatest(added_at, coalesce(last_success_at, 0))) AS last_seen_at FROM ledger WHERE host IS NOT NULL GROUP BY host")
def host_ledger(spark, d):
    l = _snap(spark, d).ledger.where("host IS NOT NULL")
    return l.groupBy("host").agg(F.count("*").alias("known_urls"), F.count("last_success_at").alias("succeeded"), F.count("last_error").alias("failed"), F.min("added_at").alias("first_seen_at"), F.max(F.greatest("added_at", F.coalesce("last_success_at", F.lit(0.0)))).alias("last_seen_at"))


@query("link_check_summary", f"WITH {S.PAGES} SELECT count(*) AS links, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (status BETWEEN 300 AND 399) AS redirect, count(*) FILTER (status IS NULL OR status >= 400) AS broken FROM pg")
def link_check_summary(spark, d):
    return linkgraph.check_summary(_pages(spark, d), "status")


@query("link_bfs", f"""WITH RECURSIVE {S.PAGES}, edges AS (SELECT DISTINCT url AS source, unnest(outlinks) AS target FROM pg WHERE outlinks IS NOT NULL), seeds AS (SELECT DISTINCT url FROM url_ledger WHERE source_url IS NULL),
    walk AS (SELECT url, 0 AS depth FROM seeds UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.url WHERE w.depth < 3) SELECT url, min(depth) AS depth FROM walk GROUP BY url""")
def link_bfs(spark, d):
    edges = _pages(spark, d).where("outlinks IS NOT NULL").select(F.col("url").alias("source"), F.explode("outlinks").alias("target"))
    return linkgraph.reach(edges, table(spark, d, "url_ledger").where("source_url IS NULL").select("url"), 3)


@query("stream_host_state", _SQL["latency_ewma"])
def stream_host_state(spark, d):
    """The same means as latency_ewma, kept by a stream over the events."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    outcomes = events.where("event_type <> 'error'").select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.lit(False).alias("failed"), (F.col("value") * 10).alias("ms"))
    states = hoststate.latest_states(hoststate.run_to_table(hoststate.host_states(outcomes), "hoststate"))
    return states.where("samples > 0").select("host", "samples", F.round("ewma_ms", 6).alias("ewma_ms"), "last_ms")


# --- leases, offers and summaries ---------------------------------------------------------------


@query("lease_host_first_scan", f"WITH {S.SNAPSHOT} SELECT url, host, physical_queue, next_fetch_at, {S.penalty('latency_ewma_ms')} AS latency_penalty, added_at, scheduler_score FROM (SELECT p.*, hs.latency_ewma_ms FROM pend p LEFT JOIN hs ON hs.host_key = p.host WHERE {S.RUNNABLE}) ORDER BY next_fetch_at, latency_penalty, added_at, scheduler_score DESC, url, physical_queue LIMIT 32")
def lease_host_first_scan(spark, d):
    s = _snap(spark, d)
    return heads.scan_by_time(s.pending, s.host_state, NOW, 32)


@query("lease_batch", f"WITH {S.SNAPSHOT} SELECT url, host, physical_queue, CAST({NOW + 300} AS DOUBLE) AS lease_expires_at FROM (SELECT p.*, {S.penalty('hs.latency_ewma_ms')} AS pen FROM pend p LEFT JOIN hs ON hs.host_key = p.host WHERE {S.RUNNABLE} AND url IN (SELECT url FROM ledger WHERE terminal_reason IS NULL)) ORDER BY scheduler_score DESC, pen, next_fetch_at, added_at, url, physical_queue LIMIT 64")
def lease_batch(spark, d):
    s = _snap(spark, d)
    picked = heads.lease_by_url(s.pending, s.host_state, s.ledger, NOW, 64)
    return transitions.take_leases(picked, NOW, frontier.LEASE_SECONDS).select("url", "host", "physical_queue", "lease_expires_at")


@query("lease_diag", f"WITH {S.SNAPSHOT}, {S.HEADS} SELECT CASE WHEN EXISTS (SELECT 1 FROM pend WHERE pend.url = hd.head_url AND pend.physical_queue = hd.physical_queue) THEN 'hit' ELSE 'stale' END AS outcome, count(*) AS n FROM hd WHERE runnable_at <= {NOW} GROUP BY 1")
def lease_diag(spark, d):
    s = _snap(spark, d)
    return heads.revalidated(heads.host_heads(s.queue, s.host_state, s.host_ledger, NOW).where(F.col("runnable_at") <= NOW), s.pending)


@query("head_offer", f"""WITH {S.SNAPSHOT}, {S.HEADS}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY physical_queue, host ORDER BY next_fetch_at, added_at, scheduler_score DESC, url) AS rn, count(*) OVER (PARTITION BY physical_queue, host) AS n FROM pend WHERE next_fetch_at <= {NOW}) WHERE rn = 1)
    SELECT o.physical_queue, o.host, o.url AS head_url, o.n AS runnable_url_count FROM o LEFT JOIN hd ON hd.physical_queue = o.physical_queue AND hd.host = o.host WHERE hd.host IS NULL OR (o.next_fetch_at, o.added_at, -o.scheduler_score, o.url) < (hd.head_next_fetch_at, hd.head_added_at, -hd.head_scheduler_score, hd.head_url)""")
def head_offer(spark, d):
    """What the due pending rows offer as better heads than the present ones."""
    s = _snap(spark, d)
    return heads.better_offers(s.pending.where(F.col("next_fetch_at") <= NOW), heads.host_heads(s.queue, s.host_state, s.host_ledger, NOW))


@query("missing_heads", f"WITH {S.SNAPSHOT}, {S.LIVE} SELECT DISTINCT physical_queue, host FROM pend WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.host = pend.host AND live.physical_queue = pend.physical_queue) ORDER BY physical_queue, host LIMIT 2048")
def missing_heads(spark, d):
    s = _snap(spark, d)
    live = heads.live_heads(s.queue, s.host_state, NOW).withColumnRenamed("url", "head_url")
    return heads.repair_scan(s.pending, live)[1].orderBy("physical_queue", "host").limit(2048)


@query("dirty_heads", f"WITH {S.SNAPSHOT} SELECT physical_queue, host, min(added_at) AS marked_at FROM member JOIN q USING (url) WHERE contains(place, ':') GROUP BY 1, 2 ORDER BY marked_at, physical_queue, host LIMIT 2048")
def dirty_heads(spark, d):
    """(queue, host) pairs touched by blocked or leased URLs, oldest mark first."""
    s = _snap(spark, d)
    touched = invariants.memberships(s).where(F.col("place").contains(":")).select("url").join(s.queue, "url")
    return touched.groupBy("physical_queue", "host").agg(F.min("added_at").alias("marked_at")).orderBy("marked_at", "physical_queue", "host").limit(2048)


@query("admission_rank", f"WITH {S.LINKS} SELECT page, url, CAST(value AS INT) AS value, CAST(r AS INT) AS r FROM r1")
def admission_rank(spark, d):
    return discovery.ranked_candidates(discovery.decided_links(_scored(spark, d), _CONTROL)).select("page", "url", F.col("value").cast("int").alias("value"), "r")


@query("admission_reasons", f"WITH {S.LINKS} SELECT parent_host, reason, count(*) AS n FROM decided GROUP BY 1, 2")
def admission_reasons(spark, d):
    return discovery.decided_links(_scored(spark, d), _CONTROL).groupBy("parent_host", "reason").agg(F.count("*").alias("n"))


@query("admit", f"""WITH {_TASKS}, {S.LEDGER} SELECT l.url, l.host, 'scheduled' AS physical_queue, l.discovery_value AS scheduler_score, l.next_fetch_at, {S.branch('l.url')} AS branch_key FROM ledger l JOIN tasks t ON t.url = l.url WHERE l.terminal_reason IS NULL AND l.last_success_at IS NULL""")
def admit(spark, d):
    return transitions.admit(_snap(spark, d).ledger, transitions.prepare_tasks(_tasks(spark, d)))


@query("requeue_failed", f"WITH {S.SNAPSHOT} SELECT url, host, 'retry' AS current_intent, CAST({NOW} AS DOUBLE) AS next_fetch_at, 'scheduled' AS physical_queue, fail_streak FROM ledger WHERE terminal_reason IS NOT NULL AND last_error IS NOT NULL")
def requeue_failed(spark, d):
    return transitions.requeue_failed(_snap(spark, d))


@query("seed_upsert", f"WITH {S.LEDGER} SELECT url, CAST(2.0 AS DOUBLE) AS discovery_value, 0 AS fail_streak, 'runnable' AS physical_queue, {S.branch('url')} AS branch_key FROM ledger WHERE source_url IS NULL")
def seed_upsert(spark, d):
    s = _snap(spark, d)
    return transitions.seed_upsert(s.ledger, s.ledger.where("source_url IS NULL").select("url")).select("url", "discovery_value", "fail_streak", "physical_queue", "branch_key")


@query("effective_states", f"{_STATES}, j AS (SELECT p.*, hs.next_request_at, hs.backoff_until FROM pend p LEFT JOIN hs ON hs.host_key = p.host) SELECT 'blocked' AS state, (SELECT count(*) FROM j WHERE next_fetch_at <= {NOW} AND (coalesce(next_request_at, 0) > {NOW} OR coalesce(backoff_until, 0) > {NOW})) + (SELECT count(*) FROM blocked) AS n UNION ALL SELECT 'runnable', (SELECT count(*) FROM j WHERE {S.RUNNABLE}) UNION ALL SELECT 'scheduled', (SELECT count(*) FROM j WHERE next_fetch_at > {NOW}) UNION ALL SELECT state, count(*) FROM st WHERE state IN ('leased', 'terminal', 'done', 'discovered') GROUP BY state")
def effective_states(spark, d):
    return reports.effective_states(_snap(spark, d))


@query("daemon_readiness", f"WITH {S.SNAPSHOT}, {S.HEADS} SELECT CAST(coalesce(sum(runnable_url_count), 0) AS BIGINT) AS pending, count(DISTINCT host) FILTER (runnable_at <= {NOW}) AS runnable_hosts, min(greatest(runnable_at - {NOW}, 0.0)) AS next_delay, (SELECT count(*) FROM blocked) AS quarantined, 'heads' AS source FROM hd")
def daemon_readiness(spark, d):
    s = _snap(spark, d)
    return reports.daemon_readiness(heads.host_heads(s.queue, s.host_state, s.host_ledger, NOW), s)


@query("observation")
def observation(spark, d):
    """One JSON document: totals, readiness, states, errors and storage."""
    s = _snap(spark, d)
    return reports.observation(s, _pages(spark, d))


@query("cycle_throughput", f"WITH {S.PAGES} SELECT CAST(floor(crawled_at / 86400) AS BIGINT) AS day, count(*) AS pages, round(count(*) / 86400.0, 6) AS pages_a_second FROM pg GROUP BY 1")
def cycle_throughput(spark, d):
    day = F.floor(F.col("crawled_at") / 86400).cast("long").alias("day")
    return _pages(spark, d).groupBy(day).agg(F.count("*").alias("pages")).withColumn("pages_a_second", F.round(F.col("pages") / 86400.0, 6))


def _all() -> None:
    """The queries of the other modules register themselves."""
    from crawlquarry.plans import upkeep  # noqa: F401


def queries():
    _all()
    return dict(_QUERIES)


def oracle_sql():
    _all()
    return dict(_SQL)
