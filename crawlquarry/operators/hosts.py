"""Per-host folds over ordered events, without gathering a host's events in one place where avoidable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions import policy, urls
from crawlquarry.operators import skew


def latency_ewma(samples: DataFrame, host: str, order: list[str], value: str) -> DataFrame:
    """(host, samples, ewma_ms, last_ms): exponentially weighted means of ordered samples.

    The recurrence unrolls to a weighted sum: sample i of n weighs alpha (1 - alpha)^(n - i), the first
    (1 - alpha)^(n - 1). Ranks come from a range partitioning, and the sum is combined before its
    shuffle, so no host's samples meet in one task. Null and non-positive samples are left out.
    """
    good = samples.where(F.col(value) > 0)
    by = [F.col(c) for c in order]
    ranks = skew.ranked(skew.in_ranges(good, host, by), [host], by, "i")
    counts = good.groupBy(host).agg(F.count("*").alias("samples"))
    j = ranks.join(counts, host)
    keep = 1 - policy.EWMA_ALPHA
    weight = F.pow(F.lit(keep), F.col("samples") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(policy.EWMA_ALPHA)
    last = F.max(F.when(F.col("i") == F.col("samples"), F.col(value)))
    return j.groupBy(host, "samples").agg(F.sum(weight * F.col(value)).alias("ewma_ms"), last.alias("last_ms")).select(F.col(host).alias("host"), "samples", "ewma_ms", "last_ms")


def host_outcomes(events: DataFrame, host: str, at: str, ident: str, failed: str) -> DataFrame:
    """(host, successes, failures, last_success_at, last_failure_at, consecutive_failures, backoff_until).

    Failures since the last success make the streak; each failure of it pushes the backoff
    to its time plus the backoff of the streak so far.
    """
    ev = events.select(F.col(host).alias("host"), F.col(at).cast("double").alias("at"), F.col(ident).alias("id"), F.col(failed).alias("failed"))
    ok = F.struct("at", "id")
    per = ev.groupBy("host").agg(
        F.sum(F.when(F.col("failed"), 0).otherwise(1)).alias("successes"), F.sum(F.when(F.col("failed"), 1).otherwise(0)).alias("failures"),
        F.max(F.when(~F.col("failed"), F.col("at"))).alias("last_success_at"), F.max(F.when(F.col("failed"), F.col("at"))).alias("last_failure_at"), F.max(F.when(~F.col("failed"), ok)).alias("last_ok"),
    )
    since = ev.where("failed").join(per.select("host", "last_ok"), "host").where(F.col("last_ok").isNull() | (F.struct("at", "id") > F.col("last_ok")))
    by = [F.col("at"), F.col("id")]
    streak = skew.ranked(skew.in_ranges(since, "host", by), ["host"], by, "nth").groupBy("host").agg(F.max("nth").alias("consecutive_failures"), F.max(F.col("at") + policy.host_backoff(F.col("nth"))).alias("backoff_until"))
    return per.drop("last_ok").join(streak, "host", "left").select("host", "successes", "failures", "last_success_at", "last_failure_at", F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), F.coalesce("backoff_until", F.lit(0.0)).alias("backoff_until"))


def pacing_slots(requests: DataFrame, host: str, at: str, ident: str, delay: float) -> DataFrame:
    """(host, id, slot, wait): when each request may start if starts on a host lie ``delay`` apart.

    The recurrence slot = max(at, previous slot + delay) unrolls to n * delay plus the running
    maximum of at - n * delay; both are carried over ranges of (host, time), so a hot host is spread.
    """
    r = requests.select(F.col(host).alias("host"), F.col(at).cast("double").alias("at"), F.col(ident).alias("id"))
    by = [F.col("at"), F.col("id")]
    r = skew.ranked(skew.in_ranges(r, "host", by), ["host"], by, "n")
    r = skew.running_max(r, ["host"], by, F.col("at") - F.col("n") * delay, "top")
    return r.withColumn("slot", F.col("top") + F.col("n") * delay).select("host", "id", F.round("slot", 3).alias("slot"), F.round(F.col("slot") - F.col("at"), 3).alias("wait"))


def with_new_hosts(states: DataFrame, hosts: DataFrame, delay: float, now: float) -> DataFrame:
    """Host states with a fresh one for each of ``hosts`` (host_key) that has none."""
    new = hosts.where(F.col("host_key").isNotNull()).select("host_key").distinct().join(states.select("host_key"), "host_key", "left_anti")
    fresh = {"crawl_delay_seconds": F.lit(delay), "updated_at": F.lit(now), "latency_sample_count": F.lit(0), "consecutive_failures": F.lit(0)}
    columns = [fresh.get(f.name, F.lit(0.0)).cast(f.dataType).alias(f.name) for f in states.schema if f.name != "host_key"]
    return states.unionByName(new.select("host_key", *columns))


def after_robots(states: DataFrame, checks: DataFrame) -> DataFrame:
    """Host states after robots checks (host_key, crawl_delay_seconds, checked_at): the latest check of a host sets its delay and time."""
    last = checks.groupBy("host_key").agg(F.max(F.struct("checked_at", F.col("crawl_delay_seconds").alias("delay"))).alias("c")).select("host_key", "c.checked_at", "c.delay")
    j = states.join(last, "host_key", "left")
    return j.withColumns({
        "crawl_delay_seconds": F.coalesce("delay", "crawl_delay_seconds"), "robots_checked_at": F.coalesce("checked_at", "robots_checked_at"), "updated_at": F.coalesce("checked_at", "updated_at"),
    }).drop("checked_at", "delay")


def ledger_after_events(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Host ledger after events (host, kind, at, n, robots_status): kind is ``discovered``, ``success``, ``failure`` or ``robots``.

    Counters grow by the events (``n`` URLs for a discovery), times only move outwards: the first sight
    by discoveries alone, the last by any. Unknown hosts get a row; events are combined by host before they meet the ledger.
    """
    kind = lambda *k: F.col("kind").isin(*k)
    latest = lambda *k: F.max(F.when(kind(*k), F.col("at")))
    count = lambda k, by: F.coalesce(F.sum(F.when(kind(k), by)), F.lit(0)).cast("long")
    e = events.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.min(F.when(kind("discovered"), F.col("at"))).alias("e_first"), F.min("at").alias("e_any"), F.max("at").alias("e_last"), latest("success").alias("e_ok"), latest("failure").alias("e_bad"), latest("robots").alias("e_robots"),
        F.max_by("robots_status", F.when(kind("robots"), F.struct("at", F.coalesce("robots_status", F.lit(""))))).alias("e_status"),
        count("discovered", F.greatest(F.col("n"), F.lit(0))).alias("e_known"), count("success", F.lit(1)).alias("e_successes"), count("failure", F.lit(1)).alias("e_failures"),
    )
    j = ledger.join(e, "host", "full")
    zero = F.lit(0).cast("long")
    return j.select(
        "host", F.coalesce("registrable_domain", urls.registrable_domain("host")).alias("registrable_domain"),
        F.coalesce(F.least("first_seen_at", "e_first"), "e_any").alias("first_seen_at"), F.greatest("last_seen_at", "e_last").alias("last_seen_at"),
        F.greatest("last_success_at", "e_ok").alias("last_success_at"), F.greatest("last_failure_at", "e_bad").alias("last_failure_at"),
        (F.coalesce("known_url_count", zero) + F.coalesce("e_known", zero)).alias("known_url_count"), (F.coalesce("success_count", zero) + F.coalesce("e_successes", zero)).alias("success_count"), (F.coalesce("failure_count", zero) + F.coalesce("e_failures", zero)).alias("failure_count"),
        F.coalesce("e_robots", "robots_last_checked_at").alias("robots_last_checked_at"), F.when(F.col("e_robots").isNotNull(), F.col("e_status")).otherwise(F.col("robots_status")).alias("robots_status"),
    )
