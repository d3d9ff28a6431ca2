"""Aggregations and reports over a frontier snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions import content, policy
from crawlquarry.operators import skew
from crawlquarry.operators.frontier import QUEUES, Snapshot
from crawlquarry.operators.heads import is_runnable, with_host_state
from crawlquarry.session import materialize

INTENTS = ("explore", "refresh", "retry")


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def page_totals(pages: DataFrame) -> DataFrame:
    """One row: pages, hosts, first and last crawl, declared and stored bytes."""
    return pages.agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"), F.min("crawled_at").alias("first_crawl"), F.max("crawled_at").alias("last_crawl"), F.sum(F.col("content_length").cast("long")).alias("content_length"), F.sum(F.col("stored_content_bytes").cast("long")).alias("stored_content_bytes"))


def storage_tiers(pages: DataFrame) -> DataFrame:
    """Pages and bytes of each storage tier and reason."""
    return pages.groupBy("storage_tier", "storage_reason").agg(
        F.count("*").alias("pages"), F.sum(F.coalesce(F.col("content_length").cast("long"), F.lit(0))).alias("content_length"), F.sum(F.col("stored_content_bytes").cast("long")).alias("stored_content_bytes"),
        F.sum(F.col("outlink_count").cast("long")).alias("outlink_count"), F.sum(F.col("stored_outlink_count").cast("long")).alias("stored_outlink_count"), count_if(F.col("content_truncated")).alias("truncated"),
    )


def queue_counts(s: Snapshot) -> DataFrame:
    """Memberships of each queue, zero for empty ones."""
    names = s.ledger.sparkSession.createDataFrame([(q,) for q in QUEUES], "physical_queue string")
    return names.join(s.queue.groupBy("physical_queue").agg(F.count("*").alias("n")), "physical_queue", "left").select("physical_queue", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def intent_counts(s: Snapshot) -> DataFrame:
    """Active URLs of each intent, zero for absent ones."""
    names = s.ledger.sparkSession.createDataFrame([(i,) for i in INTENTS], "intent string")
    active = s.queue.select("url").union(s.leases.select("url")).distinct()
    counts = s.ledger.join(active, "url", "left_semi").groupBy(F.col("current_intent").alias("intent")).agg(F.count("*").alias("n"))
    return names.join(counts, "intent", "left").select("intent", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def durable_state_counts(s: Snapshot) -> DataFrame:
    """(state, n). A URL in two queues counts twice among the queued states."""
    marked = s.ledger.select("url", F.col("terminal_reason").isNotNull().alias("terminal"), F.col("last_success_at").isNotNull().alias("succeeded"))
    places = s.pending.select("url", F.col("physical_queue").alias("state")).unionByName(s.blocked.select("url", F.lit("blocked").alias("state"))).unionByName(s.leases.select("url", F.lit("leased").alias("state")))
    state = F.when(F.col("terminal"), "terminal").when(F.col("state").isNotNull(), F.col("state")).when(F.col("succeeded"), "done").otherwise("discovered")
    return marked.join(places, "url", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def readiness(s: Snapshot) -> DataFrame:
    """One row: what could run now, what waits and for what."""
    rows = with_host_state(s.pending, s.host_state)
    now = s.now
    zero = F.lit(0.0)
    due = F.col("next_fetch_at") <= now
    at = policy.runnable_at("next_fetch_at", "next_request_at", "backoff_until")
    return rows.agg(
        F.count("*").alias("pending"), F.countDistinct("host").alias("pending_hosts"), count_if(is_runnable(now)).alias("runnable"), F.countDistinct(F.when(is_runnable(now), F.col("host"))).alias("runnable_hosts"),
        count_if(~due).alias("scheduled"), count_if(due & (F.coalesce("next_request_at", zero) > now) & (F.coalesce("backoff_until", zero) <= now)).alias("next_request_wait"),
        count_if(due & (F.coalesce("backoff_until", zero) > now)).alias("backoff_wait"), F.min(F.when(at > now, at - now)).alias("next_runnable_delay"),
    )


def error_breakdown(s: Snapshot) -> DataFrame:
    """(category, n): active or terminal errors by category."""
    queued = s.queue.select("url").distinct().withColumn("queued", F.lit(True))
    active = s.ledger.join(queued, "url", "left").where(F.col("last_error").isNotNull() & (F.col("terminal_reason").isNotNull() | F.col("queued").isNotNull()))
    return active.groupBy(content.error_category("last_error").alias("category")).agg(F.count("*").alias("n")).where(F.col("category").isNotNull())


def top_hosts(rows: DataFrame, k: int = 10) -> DataFrame:
    """Hosts with the most rows."""
    return rows.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(k)


def top_blocked_hosts(s: Snapshot, k: int = 10) -> DataFrame:
    """Hosts that hold URLs back, with counts, waits and the dominant reason."""
    now, zero = s.now, F.lit(0.0)
    both = s.pending.withColumn("quarantined", F.lit(False)).unionByName(s.blocked.drop("quarantined_at").withColumn("quarantined", F.lit(True)))
    rows = with_host_state(both, s.host_state)
    backoff = F.greatest(F.coalesce("backoff_until", zero) - now, zero)
    request = F.greatest(F.coalesce("next_request_at", zero) - now, zero)
    per = rows.groupBy("host").agg(
        count_if(F.col("quarantined")).alias("quarantine"), count_if(~F.col("quarantined") & (backoff > 0)).alias("backoff"), count_if(~F.col("quarantined") & (backoff <= 0) & (request > 0)).alias("next_request"),
        F.max(backoff).alias("backoff_wait"), F.max(request).alias("request_wait"), F.count("*").alias("urls"),
    ).where((F.col("quarantine") > 0) | (F.col("backoff") > 0) | (F.col("next_request") > 0))
    reason = F.when(F.col("quarantine") > 0, "quarantine").when(F.col("backoff") > 0, "host_backoff").otherwise("next_request")
    return per.withColumn("reason", reason).orderBy(F.desc("quarantine"), F.desc("backoff"), F.desc("backoff_wait"), F.desc("urls"), "host").limit(k)


def top_slow_hosts(s: Snapshot, k: int = 10) -> DataFrame:
    """Slowest hosts with their queued URLs by queue and their request budget."""
    counts = s.queue.groupBy("host").agg(*[count_if(F.col("physical_queue") == q).alias(q) for q in QUEUES], F.count("*").alias("urls"))
    rows = s.host_state.where(F.col("latency_ewma_ms") > 0).join(counts, F.col("host_key") == F.col("host"))
    return (
        rows.select("host", *QUEUES, "urls", F.round("latency_ewma_ms", 1).alias("ewma_ms"), F.round("latency_last_ms", 1).alias("last_ms"), "latency_sample_count", "consecutive_failures", policy.host_budget("consecutive_failures", "latency_ewma_ms").alias("budget"))
        .orderBy(F.desc("ewma_ms"), F.desc("urls"), "host").limit(k)
    )


def budget_summary(slow: DataFrame) -> DataFrame:
    """One row over the reported hosts: observed, eligible, failing, greatest budget."""
    return slow.agg(F.count("*").alias("observed"), count_if(F.col("budget") > 1).alias("eligible"), count_if(F.col("consecutive_failures") > 0).alias("failing"), F.max("budget").alias("max_budget"))


def timing_summary(samples: DataFrame, stage: str, value: str) -> DataFrame:
    """Count, mean, nearest-rank percentiles and maximum of each stage.

    Samples are weighted values first, so a stage that holds most of them isn't one buffer.
    """
    known = samples.where(F.col(value).isNotNull())
    weighted = materialize(skew.weighted_values(known, F.col(stage), F.col(value)), "weighted")
    middle = skew.percentiles(weighted, {"p50_ms": 0.5, "p95_ms": 0.95})
    per = weighted.groupBy("key").agg(F.sum("weight").alias("n"), F.round(F.sum(F.col("value") * F.col("weight")) / F.sum("weight"), 4).alias("avg_ms"), F.max("value").alias("max_ms"))
    return per.join(middle, "key").select(F.col("key").alias("stage"), "n", "avg_ms", "p50_ms", "p95_ms", "max_ms")


def effective_states(s: Snapshot) -> DataFrame:
    """(state, n): queued URLs by what they wait for, and the durable states of the rest."""
    rows = with_host_state(s.pending, s.host_state)
    due = F.col("next_fetch_at") <= s.now
    state = F.when(is_runnable(s.now), "runnable").when(due, "blocked").otherwise("scheduled")
    waiting = rows.select(state.alias("state")).unionByName(s.blocked.select(F.lit("blocked").alias("state")))
    names = s.ledger.sparkSession.createDataFrame([("runnable",), ("blocked",), ("scheduled",)], "state string")
    counted = names.join(waiting.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    rest = durable_state_counts(s).where(F.col("state").isin("leased", "terminal", "done", "discovered"))
    return counted.unionByName(rest)


def daemon_readiness(heads: DataFrame, s: Snapshot) -> DataFrame:
    """One row from the heads alone: pending URLs, hosts that can run, shortest wait, quarantined URLs, and where the numbers come from.

    Where there are neither heads nor quarantined URLs the pending ones are counted themselves.
    """
    wait = F.greatest(F.col("runnable_at") - s.now, F.lit(0.0))
    summary = heads.agg(F.coalesce(F.sum("runnable_url_count"), F.lit(0)).cast("long").alias("headed"), F.countDistinct(F.when(F.col("runnable_at") <= s.now, F.col("host"))).alias("runnable_hosts"), F.min(wait).alias("next_delay"))
    # Three rows of totals; joining them isn't a product of data.
    blocked, pending = s.blocked.agg(F.count("*").alias("n")).scalar(), s.pending.agg(F.count("*").alias("n")).scalar()
    counted = summary.withColumn("quarantined", blocked).withColumn("counted", pending)
    fallback = (F.col("headed") == 0) & (F.col("quarantined") == 0)
    return counted.select(F.when(fallback, F.col("counted")).otherwise(F.col("headed")).alias("pending"), "runnable_hosts", "next_delay", "quarantined", F.when(fallback, "counts").otherwise("heads").alias("source"))


def observation(s: Snapshot, pages: DataFrame) -> DataFrame:
    """(section, json): the sections of an operator's overview, each one JSON document."""
    one = lambda name, df: df.agg(F.collect_list(F.struct("*")).alias("rows")).select(F.lit(name).alias("section"), F.to_json("rows").alias("json"))
    # Every section is a handful of rows: totals, or one a state, tier, category.
    parts = [one("pages", page_totals(pages)), one("readiness", readiness(s)), one("states", durable_state_counts(s)), one("queues", queue_counts(s)), one("errors", error_breakdown(s)), one("storage", storage_tiers(pages))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def safely(sections: dict[str, object]) -> tuple[DataFrame | None, list[str]]:
    """((section, json) of the sections that could be worked out, names of those that failed).

    A section is a function without arguments that gives a small report; one that fails leaves the others standing.
    """
    done, failed = None, []
    for name, build in sections.items():
        try:
            part = materialize(build().agg(F.collect_list(F.struct("*")).alias("rows")).select(F.lit(name).alias("section"), F.to_json("rows").alias("json")), "section")
        except Exception:  # whatever a report runs into, the rest is shown
            failed.append(name)
            continue
        done = part if done is None else done.unionByName(part)
    return done, failed


def operator_summary(s: Snapshot, pages: DataFrame, heads: DataFrame) -> DataFrame:
    """One row: what an operator looks at first, each figure from the cheapest relation that has it."""
    states = durable_state_counts(s)
    of = lambda *k: F.coalesce(F.sum(F.when(F.col("state").isin(*k), F.col("n"))), F.lit(0)).cast("long")
    totals = states.agg(of(*QUEUES).alias("pending"), of("leased").alias("leased"), of("blocked").alias("blocked"), of("terminal").alias("terminal"), of("done").alias("done"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))
    p = page_totals(pages).select("pages", F.col("hosts").alias("page_hosts"), F.col("last_crawl").alias("last_crawl_at"))
    r = daemon_readiness(heads, s).select("runnable_hosts", "next_delay", F.col("source").alias("readiness_source"))
    e = error_breakdown(s).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("active_errors"))
    one = F.lit(1)
    out = totals.withColumn("one_", one)
    for part in (p, r, e):  # each is one row
        out = out.join(F.broadcast(part.withColumn("one_", one)), "one_")
    health = F.when(F.col("runnable_hosts") > 0, "ready").when(F.col("pending") > 0, "waiting").when(F.col("blocked") > 0, "blocked").otherwise("idle")
    return out.drop("one_").withColumn("health", health)
