"""Summaries of crawl telemetry: timings of all stages, labels, queue waits, cycles and worker pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.operators import skew
from crawlquarry.session import materialize

#: The timed fields, by the part of the pipeline they belong to.
STAGES = {
    "stages": (
        "lease_ms", "precheck_ms", "robots_ms", "rate_limit_ms", "fetch_ms", "fetch_request_ms", "fetch_body_read_ms", "parse_ms", "scheduler_ms", "persist_ms", "output_ms",
        "parse_queue_wait_ms", "finalize_queue_wait_ms", "publish_queue_wait_ms", "process_ms", "slot_ms",
    ),
    "finalizer": (
        "discover_ms", "admit_ms", "admit_update_intents_ms", "admit_fetch_rows_ms", "admit_delete_membership_ms", "admit_insert_membership_ms", "admit_host_heads_ms", "admit_delete_leases_ms",
        "admit_commit_ms", "host_success_ms", "host_failure_ms", "mark_done_ms", "mark_failed_ms", "total_ms",
    ),
    "storage": ("prepare_ms", "pages_upsert_ms", "content_store_ms", "commit_ms", "total_ms"),
    "publisher": ("save_dispatch_wait_ms", "save_run_ms", "output_dispatch_wait_ms", "output_run_ms", "total_ms"),
}
#: The labels that are counted.
LABELS = (
    "fetch_outcome", "fetch_status", "robots_status", "robots_cache_status", "robots_reason", "lease_outcome", "lease_read_model", "lease_fallback", "lease_execution_tier", "finalizer_kind", "storage_tier", "storage_truncated",
)


def timing_summaries(samples: DataFrame) -> DataFrame:
    """(part, field, count, avg, p50, p95, max) of every timed field, zeros where there are no samples, values rounded to one digit.

    ``samples`` (part, field, ms). Percentiles are nearest ranks of the samples; fields with most of the samples are spread.
    """
    spark = samples.sparkSession
    known = samples.where(F.col("ms").isNotNull()).select(F.concat_ws("/", "part", "field").alias("name"), F.col("ms").cast("double").alias("ms"))
    weighted = materialize(skew.weighted_values(known, F.col("name"), F.col("ms")), "weighted")
    per = weighted.groupBy("key").agg(F.sum("weight").alias("count"), (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("avg"), F.max("value").alias("max"))
    j = per.join(skew.percentiles(weighted, {"p50": 0.5, "p95": 0.95}), "key")
    names = spark.createDataFrame([(part, f, f"{part}/{f}") for part, fields in STAGES.items() for f in fields], "part string, field string, key string")
    number = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 1).alias(c)
    return names.join(F.broadcast(j), "key", "left").select("part", "field", F.coalesce("count", F.lit(0)).cast("long").alias("count"), number("avg"), number("p50"), number("p95"), number("max"))


def label_counts(attempts: DataFrame) -> DataFrame:
    """(label, value, n): how often each value of each label occurs. Labels that aren't there, and null values, aren't counted."""
    there = [c for c in LABELS if c in attempts.columns]
    return attempts.select(*[F.col(c).cast("string").alias(c) for c in there]).unpivot([], there, "label", "value").where(F.col("value").isNotNull()).groupBy("label", "value").agg(F.count("*").alias("n"))


def queue_waits(samples: DataFrame) -> DataFrame:
    """(queue, last_ms, max_ms, max_depth): the wait of the latest dequeue, and the greatest wait and depth.

    ``samples`` (queue, at, seq, wait_ms, depth); a null wait is an enqueue, which counts for the depth alone.
    """
    last = F.max_by("wait_ms", F.when(F.col("wait_ms").isNotNull(), F.struct("at", "seq")))
    return samples.groupBy("queue").agg(F.coalesce(last, F.lit(0.0)).alias("last_ms"), F.coalesce(F.max("wait_ms"), F.lit(0.0)).alias("max_ms"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


def cycle_snapshots(cycles: DataFrame) -> DataFrame:
    """(cycle, started_at, ended_at, elapsed, pages, failures, pages_a_second): each cycle from its attempts (cycle, at, failed)."""
    per = cycles.groupBy("cycle").agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.sum((~F.col("failed")).cast("int")).cast("long").alias("pages"), F.sum(F.col("failed").cast("int")).cast("long").alias("failures"))
    elapsed = F.col("ended_at") - F.col("started_at")
    return per.withColumn("elapsed", F.round(elapsed, 3)).withColumn("pages_a_second", F.when(elapsed > 0, F.round(F.col("pages") / elapsed, 3)).otherwise(0.0))


def worker_pools(settings: DataFrame) -> DataFrame:
    """``settings`` (concurrency, probing_ratio) with the workers of each lane: one for refreshes from four on, the rest split by the ratio between probing and warm hosts.

    Halves round to even; at least one worker stays warm, and a positive ratio gives at least one prober.
    """
    total = F.greatest(F.lit(1), F.col("concurrency"))
    refresh = F.when(total >= 4, 1).otherwise(0)
    normal = total - refresh
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probing_ratio")))
    probing = F.when((normal <= 1) | (ratio <= 0), 0).otherwise(F.least(normal - 1, F.greatest(F.lit(1), F.bround(normal * ratio).cast("int"))))
    return settings.select("concurrency", "probing_ratio", normal.alias("normal"), refresh.alias("refresh"), (normal - probing).alias("warm"), probing.alias("probing"), F.greatest(F.lit(16), 4 * total).alias("queue_depth"))
