"""State changes as DataFrames: each operator takes relations and gives the changed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions import policy, urls
from crawlquarry.operators.frontier import Snapshot


def prepare_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks by normalised URL: over-long and blocked ones dropped, repeats merged.

    ``tasks``: seq, url, value, source_url, added_at, next_fetch_at, intent. The greatest value,
    the least times, and the first known source and intent by ``seq`` survive.
    """
    t = tasks.withColumn("url", urls.normalize_url("url"))
    t = t.where((urls.identity_length("url") <= urls.MAX_URL_BYTES) & (urls.egress_reason("url") == "allowed"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return t.groupBy("url").agg(F.max("value").alias("value"), first("source_url").alias("source_url"), first("intent").alias("intent"), F.min("added_at").alias("added_at"), F.min("next_fetch_at").alias("next_fetch_at"))


def ledger_upsert(ledger: DataFrame, tasks: DataFrame) -> DataFrame:
    """(url, change, …): rows inserted into, or improved in, the ledger.

    Known URLs change only if they are open, never succeeded, and something improves.
    """
    old = ledger.select("url", F.col("discovery_value").alias("o_value"), F.col("source_url").alias("o_source"), F.col("added_at").alias("o_added"), F.col("next_fetch_at").alias("o_next"), F.col("current_intent").alias("o_intent"), F.col("terminal_reason").isNotNull().alias("closed"), F.col("last_success_at").isNotNull().alias("succeeded"), F.lit(True).alias("known"))
    j = tasks.join(old, "url", "left")
    merged = j.select(
        "url", "known", "closed", "succeeded", "o_value", "o_source", "o_added", "o_next", "o_intent", F.greatest("o_value", "value").alias("discovery_value"), F.coalesce("o_source", "source_url").alias("source_url"),
        F.least("o_added", "added_at").alias("added_at"), F.least("o_next", "next_fetch_at").alias("next_fetch_at"), F.coalesce("intent", "o_intent").alias("current_intent"),
    )
    better = ~F.col("discovery_value").eqNullSafe(F.col("o_value")) | ~F.col("source_url").eqNullSafe(F.col("o_source")) | ~F.col("added_at").eqNullSafe(F.col("o_added")) | ~F.col("next_fetch_at").eqNullSafe(F.col("o_next")) | ~F.col("current_intent").eqNullSafe(F.col("o_intent"))
    change = F.when(F.col("known").isNull(), "inserted").when(~F.col("closed") & ~F.col("succeeded") & better, "updated")
    return merged.withColumn("change", change).where(F.col("change").isNotNull()).select("url", "change", "discovery_value", "source_url", "added_at", "next_fetch_at", "current_intent")


def new_urls_per_host(changes: DataFrame) -> DataFrame:
    """(host, n): inserted URLs of each host, zero where only known ones changed."""
    return changes.groupBy(urls.host_key("url").alias("host")).agg(F.sum(F.when(F.col("change") == "inserted", 1).otherwise(0)).alias("n"))


def admission_candidates(s: Snapshot, limit: int) -> DataFrame:
    """The best discovered URLs that are in no queue, quarantine or lease."""
    taken = s.queue.select("url").unionByName(s.blocked.select("url")).unionByName(s.leases.select("url")).distinct()
    open_ = s.ledger.where(F.col("terminal_reason").isNull() & F.col("last_success_at").isNull())
    return open_.join(taken, "url", "left_anti").orderBy(F.desc("discovery_value"), "next_fetch_at", "added_at", "url").limit(limit).select("url", "host", "discovery_value", "next_fetch_at", "added_at")


def recover_leases(s: Snapshot) -> DataFrame:
    """Expired leases back in their queue, with the score their failures leave them."""
    old = s.leases.where(F.col("lease_expires_at") <= s.now).join(s.ledger.select("url", "discovery_value", "fail_streak", "next_fetch_at", "added_at"), "url")
    return old.select("url", "host", "physical_queue", policy.retry_score("discovery_value", "fail_streak").alias("scheduler_score"), "next_fetch_at", "added_at", urls.branch_key("url").alias("branch_key"))


def mark_done(s: Snapshot) -> DataFrame:
    """Leased URLs after success: failures cleared, out of queues and leases."""
    return s.ledger.join(s.leases.select("url").distinct(), "url", "left_semi").select(
        "url", F.lit(s.now).alias("next_fetch_at"), F.lit(None).cast("string").alias("current_intent"), F.lit(s.now).alias("last_success_at"), F.lit(0).alias("fail_streak"), F.lit(None).cast("string").alias("last_error"),
    )


def mark_failed(s: Snapshot, failures: DataFrame) -> DataFrame:
    """(url, error, retryable) applied: retried with backoff and decayed score, or closed."""
    j = s.ledger.where(F.col("terminal_reason").isNull()).join(failures, "url")
    streak = F.col("fail_streak") + 1
    retry = F.col("retryable")
    return j.select(
        "url", streak.alias("fail_streak"), F.when(retry, policy.retry_score(F.col("discovery_value"), streak)).otherwise(F.col("discovery_value")).alias("scheduler_score"),
        F.when(retry, F.lit(s.now) + policy.retry_backoff(streak)).otherwise(F.lit(s.now)).alias("next_fetch_at"), F.when(retry, F.lit("retry")).alias("current_intent"),
        F.when(~retry, F.coalesce("error", F.lit("failed"))).alias("terminal_reason"), F.when(retry, F.lit("scheduled")).alias("physical_queue"),
    )


def rebalance(s: Snapshot) -> DataFrame:
    """Queued rows whose host is in backoff, to be blocked under their queue's name."""
    backing = s.host_state.where(F.col("backoff_until") > s.now).select(F.col("host_key").alias("host"))
    return s.queue.join(backing, "host", "left_semi").withColumn("quarantined_at", F.lit(s.now))


def retire_blocked(s: Snapshot, least_failures: int, least_age: float, limit: int) -> DataFrame:
    """Blocked rows of failing hosts, long enough in quarantine, to be closed."""
    states = s.host_state.select(F.col("host_key").alias("host"), "consecutive_failures")
    old = s.blocked.join(states, "host").where((F.col("consecutive_failures") >= least_failures) & (F.col("quarantined_at") <= s.now - least_age))
    j = old.join(s.ledger.select("url", "terminal_reason", "last_error"), "url")
    picked = j.orderBy(F.desc("consecutive_failures"), "quarantined_at", "added_at", "url", "physical_queue").limit(limit)
    return picked.select("url", "host", "physical_queue", F.coalesce("terminal_reason", "last_error", F.lit("retry_quarantine_retired")).alias("terminal_reason"))


def replace_membership(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Queue after the incoming URLs have left every queue and joined theirs."""
    kept = current.join(incoming.select("url").distinct(), "url", "left_anti")
    return kept.unionByName(incoming.select(*current.columns))


def stale_refresh(s: Snapshot, pages: DataFrame, limit: int) -> DataFrame:
    """Open URLs crawled longest ago."""
    crawled = pages.groupBy("url").agg(F.max("crawled_at").alias("crawled_at"))
    return s.ledger.where(F.col("terminal_reason").isNull()).join(crawled, "url").orderBy("crawled_at", "url").limit(limit).select("url", "host", "crawled_at")


def promote_heads(s: Snapshot, limit: int) -> DataFrame:
    """The best scheduled URL of each host that has nothing runnable."""
    busy = s.pending.where(F.col("physical_queue") == "runnable").select("host").distinct()
    rows = s.pending.where((F.col("physical_queue") == "scheduled") & (F.col("next_fetch_at") <= s.now)).join(busy, "host", "left_anti")
    best = rows.groupBy("host").agg(F.min_by(F.struct("url", "scheduler_score", "added_at"), F.struct((-F.col("scheduler_score")).alias("a"), "added_at", "url")).alias("r"))
    return best.select("host", "r.*").orderBy(F.desc("scheduler_score"), "added_at", "url").limit(limit)


def take_leases(picked: DataFrame, now: float, seconds: float) -> DataFrame:
    """Picked rows as leases; the token is new each time."""
    return picked.select("url", "host", "physical_queue", F.expr("replace(uuid(), '-', '')").alias("lease_token"), F.lit(now + seconds).alias("lease_expires_at"))


def admit(ledger: DataFrame, tasks: DataFrame) -> DataFrame:
    """Memberships of the open, never successful URLs among ``tasks``; the score is what the ledger says of them."""
    open_ = ledger.where(F.col("terminal_reason").isNull() & F.col("last_success_at").isNull())
    place = F.when(F.col("intent") == "refresh", "refresh").otherwise("scheduled")
    j = open_.join(tasks.select("url", "intent"), "url")
    return j.select("url", "host", place.alias("physical_queue"), F.col("discovery_value").alias("scheduler_score"), "next_fetch_at", urls.branch_key("url").alias("branch_key"))


def requeue_failed(s: Snapshot) -> DataFrame:
    """Closed URLs with an error, open again for a retry; their failures still count."""
    failed = s.ledger.where(F.col("terminal_reason").isNotNull() & F.col("last_error").isNotNull())
    return failed.select("url", "host", F.lit("retry").alias("current_intent"), F.lit(s.now).alias("next_fetch_at"), F.lit("scheduled").alias("physical_queue"), "fail_streak")


def seed_upsert(ledger: DataFrame, seeds: DataFrame, value: float = 2.0) -> DataFrame:
    """Seeds with full value and a clean slate, known or not, for the runnable queue."""
    known = ledger.select("url", "added_at")
    return seeds.select("url").distinct().join(known, "url", "left").select("url", F.lit(value).alias("discovery_value"), F.lit(0).alias("fail_streak"), F.lit(None).cast("string").alias("terminal_reason"), "added_at", F.lit("runnable").alias("physical_queue"), urls.branch_key("url").alias("branch_key"))
