"""SQL texts of the core views and expressions, for comparing operators with another engine."""

from __future__ import annotations

from crawlquarry.functions import content, urls

#: The moment all queries are asked at.
NOW = 1767225600.0
#: Pending URLs the admission band is derived from, and its target.
PENDING, TARGET = 650_000, 500_000

LEDGER = """
ledger AS (SELECT url, url_hash, url_length, url_identity_version, lower(host) AS host, discovery_value, source_url, added_at,
    CASE WHEN next_fetch_at = 0 THEN 0.0 ELSE next_fetch_at END AS next_fetch_at, current_intent, last_success_at, fail_streak, last_error,
    CASE WHEN terminal_reason <> '' THEN terminal_reason END AS terminal_reason, terminalized_at
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY greatest(added_at, coalesce(last_success_at, 0), coalesce(terminalized_at, 0)) DESC, next_fetch_at DESC, fail_streak DESC, discovery_value DESC,
    coalesce(host, '') DESC, coalesce(last_error, '') DESC, coalesce(current_intent, '') DESC, coalesce(url_hash, '') DESC) AS rn
    FROM url_ledger WHERE url IS NOT NULL) WHERE rn = 1)"""
PAGES = """
pg AS (SELECT * EXCLUDE (rn) REPLACE (lower(host) AS host) FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY crawled_at DESC, created_at DESC, coalesce(status, -1) DESC, coalesce(content_length, -1) DESC,
    outlink_count DESC, coalesce(title, '') DESC, url DESC, host DESC) AS rn FROM pages WHERE url_hash IS NOT NULL) WHERE rn = 1)"""
STATE = """
hs AS (SELECT lower(host_key) AS host_key, crawl_delay_seconds, CASE WHEN next_request_at = 0 THEN 0.0 ELSE next_request_at END AS next_request_at, CASE WHEN backoff_until = 0 THEN 0.0 ELSE backoff_until END AS backoff_until,
    consecutive_failures, latency_ewma_ms, latency_last_ms, latency_sample_count, robots_checked_at FROM host_state)"""
QUEUE = """
q AS (SELECT DISTINCT url, lower(host) AS host, CASE WHEN physical_queue IN ('runnable', 'scheduled', 'refresh') THEN physical_queue ELSE 'scheduled' END AS physical_queue, scheduler_score,
    CASE WHEN next_fetch_at = 0 THEN 0.0 ELSE next_fetch_at END AS next_fetch_at, added_at, branch_key FROM scheduler_queue)"""
SNAPSHOT = f"""{LEDGER}, {STATE}, {QUEUE},
hl AS (SELECT * REPLACE (lower(host) AS host) FROM host_ledger),
blocked AS (SELECT q.*, greatest(q.added_at, hs.backoff_until - 1800) AS quarantined_at FROM q JOIN hs ON hs.host_key = q.host WHERE hs.backoff_until > {NOW}),
leases AS (SELECT url, host, physical_queue, next_fetch_at + 2592000 AS lease_expires_at FROM q WHERE physical_queue = 'refresh' AND next_fetch_at <= {NOW} AND host NOT IN (SELECT host_key FROM hs WHERE backoff_until > {NOW})),
pend AS (SELECT q.* FROM q WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.url = q.url AND b.physical_queue = q.physical_queue) AND NOT EXISTS (SELECT 1 FROM leases l WHERE l.url = q.url AND l.physical_queue = q.physical_queue)),
member AS (SELECT url, physical_queue AS place FROM pend UNION ALL SELECT url, physical_queue || ':blocked' FROM blocked UNION ALL SELECT url, physical_queue || ':leased' FROM leases)"""


def penalty(x: str) -> str:
    return f"CAST(CASE WHEN coalesce({x}, 0) >= 1000 THEN 3 WHEN coalesce({x}, 0) >= 400 THEN 2 WHEN coalesce({x}, 0) >= 150 THEN 1 ELSE 0 END AS INT)"


def tier(f: str, x: str, ok: str, robots: str) -> str:
    return f"CAST(CASE WHEN coalesce({f}, 0) >= 4 OR coalesce({x}, 0) >= 5000 THEN 3 WHEN coalesce({f}, 0) >= 2 OR coalesce({x}, 0) >= 1000 THEN 2 WHEN coalesce({ok}, 0) > 0 OR coalesce({robots}, 0) > 0 THEN 0 ELSE 1 END AS INT)"


RUNNABLE = f"(next_fetch_at <= {NOW} AND coalesce(next_request_at, 0) <= {NOW} AND coalesce(backoff_until, 0) <= {NOW})"
HEADS = f"""
hd AS (SELECT physical_queue, host, url AS head_url, next_fetch_at AS head_next_fetch_at, added_at AS head_added_at, scheduler_score AS head_scheduler_score, n AS runnable_url_count, execution_tier, latency_penalty, runnable_at FROM (
  SELECT *, row_number() OVER (PARTITION BY physical_queue, host ORDER BY execution_tier, runnable_at, latency_penalty, added_at, scheduler_score DESC, url) AS rn, count(*) OVER (PARTITION BY physical_queue, host) AS n FROM (
    SELECT q.*, {tier('hs.consecutive_failures', 'hs.latency_ewma_ms', 'hl.success_count', 'hs.robots_checked_at')} AS execution_tier, {penalty('hs.latency_ewma_ms')} AS latency_penalty,
      greatest(q.next_fetch_at, coalesce(hs.next_request_at, 0), coalesce(hs.backoff_until, 0)) AS runnable_at
    FROM q LEFT JOIN hs ON hs.host_key = q.host LEFT JOIN hl ON hl.host = q.host)) WHERE rn = 1)"""
LIVE = f"""
live AS (SELECT host, url, physical_queue, scheduler_score, next_fetch_at, added_at, latency_penalty, n AS host_pending_count FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY next_fetch_at, latency_penalty, added_at, scheduler_score DESC, url, physical_queue) AS rn, count(*) OVER (PARTITION BY host) AS n FROM (
    SELECT q.*, {penalty('hs.latency_ewma_ms')} AS latency_penalty FROM q LEFT JOIN hs ON hs.host_key = q.host WHERE {RUNNABLE})) WHERE rn = 1)"""

_RE_PATH = r"'^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)'"


def scheme(u: str) -> str:
    return rf"lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1))"


def host_key(u: str) -> str:
    return f"lower(regexp_extract({u}, '^(?:[^:/?#]+:)?//([^/?#]*)', 1))"


def path(u: str) -> str:
    return f"regexp_extract({u}, {_RE_PATH}, 1)"


def normalize(u: str) -> str:
    """Normalised URL in DuckDB SQL."""
    p = path(u)
    last = f"regexp_extract({p}, '([^/]*)$', 1)"
    params = f"CASE WHEN instr({last}, ';') > 0 THEN regexp_extract({last}, '(;.*)$', 1) ELSE '' END"
    bare = f"CASE WHEN instr({last}, ';') > 0 THEN regexp_extract({p}, '^((?:.*/)?[^/;]*);', 1) ELSE {p} END"
    trimmed = f"coalesce(nullif(rtrim({bare}, '/'), ''), '/')"
    q = rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"
    decode = lambda x: f"url_decode(replace({x}, '+', ' '))"
    encode = lambda x: f"replace(replace(url_encode({x}), '%20', '+'), '*', '%2A')"
    pairs = f"list_filter(string_split({q}, '&'), lambda p: instr(p, '=') > 0)"
    structs = f"list_transform({pairs}, lambda p: {{'k': {decode('substr(p, 1, instr(p, chr(61)) - 1)')}, 'v': {decode('substr(p, instr(p, chr(61)) + 1)')}}})"
    kept = f"list_sort(list_filter({structs}, lambda s: s.v <> ''))"
    joined = f"array_to_string(list_transform({kept}, lambda s: {encode('s.k')} || '=' || {encode('s.v')}), '&')"
    return f"({scheme(u)} || '://' || {host_key(u)} || {trimmed} || {params} || CASE WHEN {joined} = '' THEN '' ELSE '?' || {joined} END)"


def branch(u: str) -> str:
    return f"('/' || array_to_string(list_slice(list_filter(string_split({path(normalize(u))}, '/'), lambda s: s <> ''), 1, 2), '/'))"


def archetype(u: str) -> str:
    p = f"lower({path(u)})"
    seg = f"list_filter(string_split({p}, '/'), lambda s: s <> '' AND s <> '.')"
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"""CASE WHEN len({seg}) BETWEEN 1 AND 2 AND {seg}[1] IN ({quoted(urls.REDIRECT_SEGMENTS)}) THEN 'redirect_hub'
      WHEN regexp_matches(coalesce({seg}[-1], ''), '^({'|'.join(urls.DOCUMENT_PREFIXES)})') OR (len({seg}) > 1 AND list_has_any({seg}[1:-2], [{quoted(urls.DOCUMENT_SEGMENTS)}])) THEN 'document_page'
      WHEN {listing(u)} THEN 'registry_listing' ELSE 'generic_page' END"""


def listing(u: str) -> str:
    return f"regexp_matches(lower({path(u)}), '/({'|'.join(urls.LISTING_SEGMENTS)})(/|$)')"


def content_type(c: str) -> str:
    return f"lower(trim(string_split(coalesce({c}, ''), ';')[1]))"


def is_text(k: str) -> str:
    kinds = ", ".join(f"'{t}'" for t in content.TEXT_APPLICATION)
    return f"(starts_with({k}, 'text/') OR {k} IN ({kinds}) OR ends_with({k}, '+xml') OR ends_with({k}, '+json'))"


def is_binary(k: str) -> str:
    kinds = ", ".join(f"'{t}'" for t in content.BINARY_APPLICATION)
    return f"(({k} IN ({kinds}) OR {' OR '.join(f'starts_with({k}, {chr(39)}{p}{chr(39)})' for p in content.BINARY_PREFIXES)}) AND NOT {is_text(k)})"


def error_category(e: str) -> str:
    status = f"try_cast(regexp_extract({e}, '^http_(-?[0-9]+)$', 1) AS INT)"
    return f"""CASE WHEN {e} IS NULL OR {e} = '' THEN NULL WHEN starts_with({e}, 'http_') THEN CASE WHEN {status} BETWEEN 400 AND 499 THEN 'http_4xx' WHEN {status} BETWEEN 500 AND 599 THEN 'http_5xx' ELSE 'http_other' END
      WHEN {e} = 'timeout' THEN 'timeout' WHEN {e} = 'connection_error' OR contains({e}, 'Server disconnected without sending a response.') THEN 'connection_error' ELSE 'other' END"""


PARENT = f"""CASE WHEN {listing('url')} OR regexp_matches(lower(coalesce(title, '')), 'index of|directory listing|{'|'.join(urls.LISTING_SEGMENTS)}') OR coalesce(content_length, 0) >= 524288
      OR ({content_type('content_type')} <> '' AND NOT contains({content_type('content_type')}, 'html')) THEN 'registry_listing' ELSE {archetype('url')} END"""
LOW_VALUE = "(coalesce(hs.consecutive_failures, 0) >= 4 OR coalesce(hl.robots_status IN ('denied', 'disallowed'), false) OR (coalesce(hl.failure_count, 0) >= 3 AND coalesce(hl.success_count, 0) = 0))"
#: Links, scores and decisions of all pages (those with an error status stand for pages that say nofollow) under the band of PENDING and TARGET (reduce: 1.0, 80, 4, 2).
LINKS = f"""{PAGES}, {STATE}, hl AS (SELECT * REPLACE (lower(host) AS host) FROM host_ledger),
seeds AS (SELECT DISTINCT lower(host) AS host FROM url_ledger WHERE source_url IS NULL AND host IS NOT NULL),
ctx AS (SELECT hl.host, {LOW_VALUE} AS low_value FROM hl LEFT JOIN hs ON hs.host_key = hl.host),
parents AS (SELECT url_hash AS page, url AS parent_url, {host_key('url')} AS parent_host, {PARENT} AS parent_archetype, coalesce(status >= 400, false) AS nofollow, outlinks FROM pg WHERE outlinks IS NOT NULL),
raw AS (SELECT page, parent_url, parent_host, parent_archetype, nofollow, unnest(outlinks) AS u FROM parents),
distinct_raw AS (SELECT DISTINCT u FROM raw),
norm AS MATERIALIZED (SELECT u, {normalize('u')} AS url FROM distinct_raw),
arch AS MATERIALIZED (SELECT url, {host_key('url')} AS host, {archetype('url')} AS archetype FROM (SELECT DISTINCT url FROM norm)),
links AS (SELECT DISTINCT raw.page, raw.parent_url, raw.parent_host, raw.parent_archetype, raw.nofollow, arch.url, arch.host, arch.archetype FROM raw JOIN norm ON norm.u = raw.u JOIN arch ON arch.url = norm.url),
scored0 AS (SELECT links.*, seeds.host IS NOT NULL AS is_seed, ctx.host IS NOT NULL AS known, coalesce(ctx.low_value, false) AS low_value,
    greatest(25, CASE WHEN links.host = parent_host THEN 125 WHEN seeds.host IS NOT NULL THEN 110 ELSE 80 END
      + CASE archetype WHEN 'document_page' THEN 15 WHEN 'redirect_hub' THEN -30 WHEN 'registry_listing' THEN -35 ELSE 0 END
      - least(35, CASE parent_archetype WHEN 'registry_listing' THEN 20 WHEN 'redirect_hub' THEN 10 ELSE 0 END + CASE WHEN nofollow THEN 15 ELSE 0 END)) AS raw_value
  FROM links LEFT JOIN seeds ON seeds.host = links.host LEFT JOIN ctx ON ctx.host = links.host),
scored AS (SELECT *, CASE WHEN low_value THEN greatest(25, raw_value - 35) ELSE raw_value END AS value FROM scored0),
decided AS (SELECT *, CASE WHEN nofollow THEN 'nofollow_parent' WHEN archetype IN ('redirect_hub', 'registry_listing') THEN 'low_value_archetype' WHEN low_value AND value < 100 THEN 'host_policy_penalty' WHEN value < 100 THEN 'score_below_threshold' ELSE 'candidate' END AS reason FROM scored),
r1 AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY value DESC, url) AS r, (host <> parent_host AND NOT is_seed AND host <> '' AND NOT known) AS is_new FROM decided WHERE reason = 'candidate'),
r2 AS (SELECT *, min(r) OVER (PARTITION BY page, host) AS first_r FROM r1),
r3 AS (SELECT *, is_new AND dense_rank() OVER (PARTITION BY page, is_new ORDER BY first_r) > 2 AS pressure FROM r2),
r4 AS (SELECT *, NOT pressure AND row_number() OVER (PARTITION BY page, host, pressure ORDER BY r) <= 4 AS stays FROM r3),
capped AS (SELECT *, CASE WHEN coalesce(sum(CAST(stays AS INT)) OVER (PARTITION BY page ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 80 THEN 'per_page_cap' WHEN pressure THEN 'new_host_pressure' WHEN NOT stays THEN 'per_target_host_cap' ELSE 'admitted' END AS outcome FROM r4)"""
#: The HTML that stands for a page: its title and its outlinks as anchors.
HTML = r"""('<html><head><title>' || coalesce(title, '') || '</title></head><body><p class="lead">' || coalesce(title, '') || '</p>' || array_to_string(list_transform(coalesce(outlinks, []), lambda u: '<a href="' || u || '">' || u || '</a>'), ' ') || '</body></html>')"""
