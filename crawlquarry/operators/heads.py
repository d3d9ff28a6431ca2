"""Per-host heads and lease orders: windows and top-k over the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlquarry.functions import policy
from crawlquarry.operators import skew


def with_host_state(queue: DataFrame, host_state: DataFrame) -> DataFrame:
    """Queue rows with the state of their host (nulls where there is none)."""
    columns = host_state.select(F.col("host_key").alias("host"), "next_request_at", "backoff_until", "consecutive_failures", "latency_ewma_ms", "latency_last_ms", "latency_sample_count", "robots_checked_at")
    return queue.join(columns, "host", "left")


def is_runnable(now: float) -> Column:
    zero = F.lit(0.0)
    return (F.col("next_fetch_at") <= now) & (F.coalesce("next_request_at", zero) <= now) & (F.coalesce("backoff_until", zero) <= now)


def best_per(df: DataFrame, keys: list[str], order: list[Column], descending: tuple[int, ...] = ()) -> DataFrame:
    """The first row of each group by ``order`` as an aggregation (numbers at ``descending`` places are negated)."""
    parts = [(-c if i in descending else c).alias(f"o{i}") for i, c in enumerate(order)]
    return df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*parts)).alias("r"), F.count("*").alias("group_rows")).select("r.*", "group_rows")


def host_heads(queue: DataFrame, host_state: DataFrame, host_ledger: DataFrame, now: float) -> DataFrame:
    """One row a (queue, host): its best URL by tier, time it can run, penalty, age, score and URL, with the host's number of URLs."""
    counts = host_ledger.select("host", "success_count")
    joined = with_host_state(queue, host_state).join(counts, "host", "left")
    joined = joined.withColumns({
        "execution_tier": policy.execution_tier("consecutive_failures", "latency_ewma_ms", "success_count", "robots_checked_at"),
        "latency_penalty": policy.latency_penalty("latency_ewma_ms"),
        "runnable_at": policy.runnable_at("next_fetch_at", "next_request_at", "backoff_until"),
    })
    order = [F.col(c) for c in ("execution_tier", "runnable_at", "latency_penalty", "added_at", "scheduler_score", "url")]
    head = best_per(joined, ["physical_queue", "host"], order, descending=(4,))
    return head.select(
        "physical_queue", "host", F.col("url").alias("head_url"), F.col("next_fetch_at").alias("head_next_fetch_at"), F.col("added_at").alias("head_added_at"), F.col("scheduler_score").alias("head_scheduler_score"),
        F.col("group_rows").alias("runnable_url_count"), "execution_tier", "latency_penalty", "runnable_at",
    )


def live_heads(queue: DataFrame, host_state: DataFrame, now: float) -> DataFrame:
    """Runnable heads straight from the queue: per host by time, penalty, age, score and URL, with the host's runnable URLs."""
    rows = with_host_state(queue, host_state).where(is_runnable(now)).withColumn("latency_penalty", policy.latency_penalty("latency_ewma_ms"))
    order = [F.col(c) for c in ("next_fetch_at", "latency_penalty", "added_at", "scheduler_score", "url", "physical_queue")]
    return best_per(rows, ["host"], order, descending=(3,)).select("host", "url", "physical_queue", "scheduler_score", "next_fetch_at", "added_at", "latency_penalty", F.col("group_rows").alias("host_pending_count"))


def lease_by_url(queue: DataFrame, host_state: DataFrame, ledger: DataFrame, now: float, limit: int) -> DataFrame:
    """The next URLs to lease by score, penalty, time, age and URL among those still open."""
    open_ = ledger.where(F.col("terminal_reason").isNull()).select("url")
    rows = with_host_state(queue, host_state).where(is_runnable(now)).join(open_, "url", "left_semi").withColumn("latency_penalty", policy.latency_penalty("latency_ewma_ms"))
    return rows.orderBy(F.desc("scheduler_score"), "latency_penalty", "next_fetch_at", "added_at", "url", "physical_queue").limit(limit).select("url", "host", "physical_queue", "scheduler_score", "next_fetch_at", "added_at", "latency_penalty")


def lease_by_host(heads: DataFrame, limit: int) -> DataFrame:
    """The next hosts to lease from, fewest pending URLs first."""
    return heads.orderBy("host_pending_count", "latency_penalty", "next_fetch_at", "added_at", F.desc("scheduler_score"), "url").limit(limit)


def read_heads(heads: DataFrame, now: float, limit: int = 128) -> DataFrame:
    """Heads that can run now in reading order."""
    order = ["execution_tier", "runnable_url_count", "latency_penalty", "head_next_fetch_at", "head_added_at", F.desc("head_scheduler_score"), "physical_queue", "head_url"]
    return heads.where(F.col("runnable_at") <= now).orderBy(*order).limit(limit)


def overcrowded(queue: DataFrame, per_host: int, per_branch: int) -> DataFrame:
    """Rows beyond the quota of their host or branch, with both ranks.

    Both ranks come from one range partitioning by host and order, so a hot host is spread.
    """
    order = [F.desc("scheduler_score"), F.asc("next_fetch_at"), F.asc("added_at"), F.asc("url"), F.asc("physical_queue")]
    parts = skew.in_ranges(queue, "host", order)
    rows = skew.ranked(skew.ranked(parts, ["host"], order, "host_rank"), ["host", "branch_key"], order, "branch_rank")
    return rows.where((F.col("host_rank") > per_host) | (F.col("branch_rank") > per_branch)).select("url", "host", "branch_key", "physical_queue", "host_rank", "branch_rank")


def top_per_host(rows: DataFrame, order: list, per_host: int) -> DataFrame:
    """The first ``per_host`` rows of each host; the rank filter is pushed below the exchange."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(*order))).where(F.col("rank") <= per_host)


def repair_scan(queue: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orphan heads, queued hosts without a head)."""
    orphans = heads.join(queue.select(F.col("url").alias("head_url"), "physical_queue").distinct(), ["head_url", "physical_queue"], "left_anti")
    missing = queue.select("physical_queue", "host").distinct().join(heads.select("physical_queue", "host"), ["physical_queue", "host"], "left_anti")
    return orphans, missing


def scan_by_time(queue: DataFrame, host_state: DataFrame, now: float, limit: int) -> DataFrame:
    """Runnable URLs by time, penalty, age, score and URL, without regard to hosts."""
    rows = with_host_state(queue, host_state).where(is_runnable(now)).withColumn("latency_penalty", policy.latency_penalty("latency_ewma_ms"))
    columns = ("url", "host", "physical_queue", "next_fetch_at", "latency_penalty", "added_at", "scheduler_score")
    return rows.orderBy("next_fetch_at", "latency_penalty", "added_at", F.desc("scheduler_score"), "url", "physical_queue").limit(limit).select(*columns)


def revalidated(heads: DataFrame, pending: DataFrame) -> DataFrame:
    """(outcome, n): heads whose URL is still pending, and stale ones."""
    there = pending.select(F.col("url").alias("head_url"), "physical_queue", F.lit(True).alias("there")).distinct()
    outcome = F.when(F.col("there"), "hit").otherwise("stale")
    return heads.join(there, ["head_url", "physical_queue"], "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def better_offers(batch: DataFrame, heads: DataFrame) -> DataFrame:
    """Best row of each (queue, host) of a batch where it strictly beats the present head; the count is the batch's."""
    offer = best_per(batch, ["physical_queue", "host"], [F.col(c) for c in ("next_fetch_at", "added_at", "scheduler_score", "url")], descending=(2,))
    j = offer.join(heads.select("physical_queue", "host", "head_next_fetch_at", "head_added_at", "head_scheduler_score", "head_url"), ["physical_queue", "host"], "left")
    new = F.struct(F.col("next_fetch_at").alias("a"), F.col("added_at").alias("b"), (-F.col("scheduler_score")).alias("c"), F.col("url").alias("d"))
    old = F.struct(F.col("head_next_fetch_at").alias("a"), F.col("head_added_at").alias("b"), (-F.col("head_scheduler_score")).alias("c"), F.col("head_url").alias("d"))
    return j.where(F.col("head_url").isNull() | (new < old)).select("physical_queue", "host", F.col("url").alias("head_url"), F.col("group_rows").alias("runnable_url_count"))


def refreshed_heads(heads: DataFrame, dirty: DataFrame, queue: DataFrame, host_state: DataFrame, host_ledger: DataFrame, now: float) -> DataFrame:
    """Heads after the (physical_queue, host) pairs of ``dirty`` are worked out again; all others stay as they are.

    Only the queue rows of dirty hosts are read into the aggregation; a dirty host without rows loses its head.
    """
    marks = dirty.select("physical_queue", "host").distinct()
    key = ["physical_queue", "host"]
    again = host_heads(queue.join(marks, key, "left_semi"), host_state, host_ledger, now)
    return heads.join(marks, key, "left_anti").unionByName(again)
