"""Putting URLs back, delaying crowded ones, placing discovered ones, and closing a batch of successes.

Each operator takes relations and gives the changed rows; nothing is changed in place. Queue
rows it gives replace whatever rows the URL has (``transitions.replace_membership``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions import urls
from crawlquarry.operators import heads, hosts, transitions
from crawlquarry.operators.frontier import Snapshot

#: The queue an intent goes to, and the intent a queue implies.
QUEUE_OF_INTENT = {"explore": "scheduled", "refresh": "refresh", "retry": "scheduled"}
INTENT_OF_QUEUE = {"runnable": "explore", "scheduled": "explore", "refresh": "refresh"}


def requeue_urls(s: Snapshot, wanted: DataFrame, queue: str | None = None, intent: str | None = None, at: float | None = None) -> DataFrame:
    """Queue rows of the known URLs among ``wanted`` (url), open again, due ``at`` (now), failures kept, with ``current_intent``.

    URLs are normalised; over-long ones are left out, unknown ones too. The queue follows from the intent and the intent from the queue.
    """
    queue = queue or QUEUE_OF_INTENT.get(intent, "scheduled")
    intent = intent or INTENT_OF_QUEUE[queue]
    u = wanted.where(F.col("url").isNotNull()).select(urls.normalize_url("url").alias("url")).where(urls.identity_length("url") <= urls.MAX_URL_BYTES).distinct()
    known = s.ledger.join(u, "url", "left_semi")
    return known.select(
        "url", "host", F.lit(queue).alias("physical_queue"), F.col("discovery_value").alias("scheduler_score"), F.lit(float(s.now if at is None else at)).alias("next_fetch_at"), "added_at",
        urls.branch_key("url").alias("branch_key"), F.lit(intent).alias("current_intent"), "fail_streak",
    )


def requeue_refresh_urls(s: Snapshot, wanted: DataFrame, at: float | None = None) -> DataFrame:
    """Known URLs for the refresh queue."""
    return requeue_urls(s, wanted, queue="refresh", intent="refresh", at=at)


def place_many(s: Snapshot, tasks: DataFrame) -> DataFrame:
    """(inserted, updated, admitted, placed): what placing tasks does to the ledger and the queues.

    Placed is the number of changed ledger rows, or 0 if something changed but nothing could be admitted.
    """
    prepared = transitions.prepare_tasks(tasks)
    changes = transitions.ledger_upsert(s.ledger, prepared)
    taken = s.queue.select("url").unionByName(s.blocked.select("url")).unionByName(s.leases.select("url")).distinct()
    closed = s.ledger.where(F.col("terminal_reason").isNotNull() | F.col("last_success_at").isNotNull()).select("url")
    admitted = prepared.select("url").join(closed, "url", "left_anti").join(taken, "url", "left_anti")
    events = changes.select("change").unionByName(admitted.select(F.lit("admitted").alias("change")))
    n = lambda k: F.coalesce(F.sum(F.when(F.col("change") == k, 1)), F.lit(0)).cast("long")
    out = events.agg(n("inserted").alias("inserted"), n("updated").alias("updated"), n("admitted").alias("admitted"))
    changed = F.col("inserted") + F.col("updated")
    return out.withColumn("placed", F.when((F.col("admitted") == 0) & (changed > 0), F.lit(0).cast("long")).otherwise(changed))


def delay_overcrowded(s: Snapshot, per_host: int, per_branch: int, limit: int | None, delay: float) -> DataFrame:
    """Scheduled rows of crowded hosts and branches, due after the delay, with the score the ledger gives them.

    Of the due rows beyond a quota those furthest beyond go first, at most ``limit``. Quotas and limits of 0 delay nothing.
    """
    due = s.queue.where((F.col("physical_queue") == "scheduled") & (F.col("next_fetch_at") <= s.now))
    if per_host <= 0 or per_branch <= 0 or (limit is not None and limit <= 0):
        due = due.where(F.lit(False))
    crowd = heads.overcrowded(due, per_host, per_branch)
    if limit is not None:
        crowd = crowd.orderBy(F.desc("host_rank"), F.desc("branch_rank"), "url").limit(limit)
    j = s.ledger.join(crowd.select("url").distinct(), "url")
    return j.select(
        "url", "host", F.lit("scheduled").alias("physical_queue"), F.col("discovery_value").alias("scheduler_score"), F.greatest("next_fetch_at", F.lit(s.now + delay)).alias("next_fetch_at"), "added_at", urls.branch_key("url").alias("branch_key"),
    )


def finalize_successes(s: Snapshot, done: DataFrame, tasks: DataFrame) -> dict[str, DataFrame]:
    """What a batch of successes changes: ``discovered`` and ``admitted`` new links, ``done`` ledger rows, ``hosts`` with their latencies.

    ``done`` (seq, url, ms) are fetched pages, whether or not their lease is still held; ``tasks`` their links. A URL fetched twice is done once.
    """
    prepared = transitions.prepare_tasks(tasks)
    closed = s.ledger.join(done.select("url").distinct(), "url", "left_semi")
    samples = done.where(F.col("ms").isNotNull()).select(urls.host_key("url").alias("host_key"), "seq", "ms")
    reset = done.select(urls.host_key("url").alias("host")).distinct()
    latencies = hosts.latency_ewma(samples, "host_key", ["seq"], "ms")
    return {
        "discovered": transitions.ledger_upsert(s.ledger, prepared),
        "admitted": transitions.admit(s.ledger, prepared),
        "done": closed.select("url", F.lit(s.now).alias("last_success_at"), F.lit(0).alias("fail_streak"), F.lit(None).cast("string").alias("last_error")),
        "hosts": reset.join(latencies, "host", "left").select("host", F.coalesce("samples", F.lit(0)).alias("samples"), "ewma_ms", F.lit(0).alias("consecutive_failures"), F.lit(0.0).alias("backoff_until")),
    }


def lease_from_heads(s: Snapshot, model: DataFrame, limit: int, lookahead: int = 128, tiers: tuple[int, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(leases, diagnostics): the next URLs by host, from the read model of heads, and by a scan where that has nothing.

    Heads that can run are looked up in the order of reading, each against the pending rows, the host's
    state and the ledger. Those that no longer hold are stale and counted; if no head
    holds and no tier is asked for, the due queue is scanned by time instead. The diagnostics are one row: outcome
    (``hit``, ``stale`` or ``miss``), candidates, stale heads, whether the leases come from the scan.
    """
    heads_ = model if tiers is None else model.where(F.col("execution_tier").isin(*tiers))
    wanted = heads.read_heads(heads_, s.now, lookahead)
    open_ = s.ledger.where(F.col("terminal_reason").isNull()).select("url")
    live = heads.with_host_state(s.pending, s.host_state).where(heads.is_runnable(s.now)).join(open_, "url", "left_semi")
    found = wanted.join(live.select(F.col("url").alias("head_url"), "physical_queue", F.lit(True).alias("live")).distinct(), ["head_url", "physical_queue"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
    order = ["execution_tier", "runnable_url_count", "latency_penalty", "head_next_fetch_at", "head_added_at", F.desc("head_scheduler_score"), "physical_queue", "head_url"]
    hits = found.where("live").orderBy(*order).limit(limit).select(F.col("head_url").alias("url"), "host", "physical_queue")
    totals = found.agg(F.count("*").alias("candidates"), F.coalesce(F.sum((~F.col("live")).cast("int")), F.lit(0)).cast("long").alias("stale"))
    some = totals.select((F.col("candidates") > F.col("stale")).alias("some"))
    scan = heads.scan_by_time(s.pending.join(open_, "url", "left_semi"), s.host_state, s.now, limit).select("url", "host", "physical_queue")
    # The scan counts only where no head held; the condition is one row.
    nothing = some.where("NOT some").select(F.lit(1).alias("one_"))
    scan = scan.where(F.lit(tiers is None)).withColumn("one_", F.lit(1)).join(F.broadcast(nothing), "one_", "left_semi").drop("one_")
    outcome = F.when(F.col("candidates") > F.col("stale"), "hit").when(F.col("stale") > 0, "stale").otherwise("miss")
    diagnostics = totals.select(outcome.alias("outcome"), "candidates", "stale", ((F.col("candidates") == F.col("stale")) & F.lit(tiers is None)).alias("scanned"))
    return hits.unionByName(scan), diagnostics


def apply_upkeep(s: Snapshot, pages: DataFrame, limits: dict[str, int], keep: object) -> tuple[Snapshot, dict[str, int]]:
    """(snapshot afterwards, changes of each step): one round of upkeep, every step on the state the last one left.

    Order: expired leases recovered, discovered URLs admitted, hosts in backoff quarantined, stale pages queued for
    refresh, crowded rows delayed, old quarantined rows retired, scheduled heads promoted. ``keep`` writes a
    relation durably between steps, so the plan stays short.
    """
    import dataclasses

    changes: dict[str, int] = {}

    def step(name: str, changed: DataFrame, apply) -> None:
        nonlocal s
        changed = keep(changed, name)
        changes[name] = changed.count()
        s = dataclasses.replace(s, **{k: keep(v, k) for k, v in apply(changed).items()})

    columns = s.queue.columns
    with_queue = lambda rows: {"queue": transitions.replace_membership(s.queue, rows.select(*columns))}
    blocked_columns = s.blocked.columns

    step("recovered", transitions.recover_leases(s), lambda c: {"leases": s.leases.join(c.select("url", "physical_queue"), ["url", "physical_queue"], "left_anti")})
    step("admitted", transitions.admission_candidates(s, limits.get("admit", 500)), lambda c: with_queue(c.withColumns({"physical_queue": F.lit("scheduled"), "scheduler_score": F.col("discovery_value"), "branch_key": urls.branch_key("url")})))
    step("quarantined", transitions.rebalance(s).join(s.blocked.select("url", "physical_queue"), ["url", "physical_queue"], "left_anti"), lambda c: {"blocked": s.blocked.unionByName(c.select(*blocked_columns))})
    stale = transitions.stale_refresh(s, pages, limits.get("refresh", 300)).select("url")
    step("refreshed", requeue_refresh_urls(s, stale), lambda c: with_queue(c))
    step("delayed", delay_overcrowded(s, limits.get("per_host", 20), limits.get("per_branch", 5), limits.get("delay", 500), 3600.0), lambda c: with_queue(c))
    retired = transitions.retire_blocked(s, 3, 60.0, limits.get("retire", 256))
    step("retired", retired, lambda c: {
        "queue": s.queue.join(c.select("url"), "url", "left_anti"), "blocked": s.blocked.join(c.select("url"), "url", "left_anti"),
        "ledger": s.ledger.join(c.groupBy("url").agg(F.min("terminal_reason").alias("reason_")), "url", "left").withColumn("terminal_reason", F.coalesce("terminal_reason", "reason_")).drop("reason_").select(*s.ledger.columns),
    })
    step("promoted", transitions.promote_heads(s, limits.get("promote", 100)), lambda c: {
        "queue": s.queue.join(c.select("url", F.lit("scheduled").alias("physical_queue"), F.lit(True).alias("up_")), ["url", "physical_queue"], "left").withColumn("physical_queue", F.when(F.col("up_"), "runnable").otherwise(F.col("physical_queue"))).select(*columns),
    })
    return s, changes
