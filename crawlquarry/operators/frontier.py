"""The state of a crawl frontier as DataFrames, and the views other operators start from.

Raw tables hold repeated rows, late older versions, null queue names and hosts in mixed case;
the views here settle them once. Every operator takes ``now`` explicitly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlquarry.session import table

QUEUES = ("runnable", "scheduled", "refresh")
SURFACES = {"runnable": ("runnable",), "scheduled": ("scheduled",), "normal": ("runnable", "scheduled"), "refresh": ("refresh",)}
LEASE_SECONDS = 300.0


def plain_zero(c: str) -> Column:
    """A double without negative zeros."""
    return F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)).alias(c)


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the greatest by ``order``.

    A rank filter: Spark applies it before the shuffle as well, and columns nobody asks for aren't read.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in order]))
    return df.withColumn("rank_", rank).where(F.col("rank_") == 1).drop("rank_")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def ledger(raw: DataFrame) -> DataFrame:
    """One row a URL: the version with the latest event."""
    seen = F.greatest("added_at", F.coalesce("last_success_at", F.lit(0.0)), F.coalesce("terminalized_at", F.lit(0.0)))
    order = [seen, F.col("next_fetch_at"), F.col("fail_streak"), F.col("discovery_value"), *map(_text, ("host", "last_error", "current_intent", "url_hash"))]
    one = latest(raw.where(F.col("url").isNotNull()), "url", order)
    return one.withColumns({"next_fetch_at": plain_zero("next_fetch_at"), "host": F.lower("host"), "terminal_reason": F.when(F.col("terminal_reason") != "", F.col("terminal_reason"))})


def pages(raw: DataFrame) -> DataFrame:
    """One row a page: the latest crawl."""
    order = [F.col("crawled_at"), F.col("created_at"), F.coalesce("status", F.lit(-1)), F.coalesce("content_length", F.lit(-1)), F.col("outlink_count"), _text("title"), F.col("url"), F.col("host")]
    return latest(raw.where(F.col("url_hash").isNotNull()), "url_hash", order).withColumn("host", F.lower("host"))


def queue(raw: DataFrame) -> DataFrame:
    """Memberships without repeats; a null or unknown queue is ``scheduled``."""
    name = F.when(F.col("physical_queue").isin(*QUEUES), F.col("physical_queue")).otherwise("scheduled")
    return raw.select("url", F.lower("host").alias("host"), name.alias("physical_queue"), "scheduler_score", plain_zero("next_fetch_at"), "added_at", "branch_key").distinct()


def host_states(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"host_key": F.lower("host_key"), "backoff_until": plain_zero("backoff_until"), "next_request_at": plain_zero("next_request_at")})


@dataclass(frozen=True)
class Snapshot:
    """All relations of one moment."""

    ledger: DataFrame
    queue: DataFrame
    blocked: DataFrame
    leases: DataFrame
    host_state: DataFrame
    host_ledger: DataFrame
    now: float

    @property
    def pending(self) -> DataFrame:
        """Memberships that are neither blocked nor leased."""
        key = ["url", "physical_queue"]
        return self.queue.join(self.blocked.select(*key), key, "left_anti").join(self.leases.select(*key), key, "left_anti")


def snapshot(spark: SparkSession, d: str, now: float) -> Snapshot:
    """The frontier in a data directory.

    The directory has no tables of blocked and leased memberships; they follow from its own rows:
    blocked are memberships of hosts in backoff, leased are due refreshes of other hosts, for a month.
    """
    q, states = queue(table(spark, d, "scheduler_queue")), host_states(table(spark, d, "host_state"))
    backing = states.where(F.col("backoff_until") > now).select(F.col("host_key").alias("host"), "backoff_until")
    blocked = q.join(backing, "host").withColumn("quarantined_at", F.greatest("added_at", F.col("backoff_until") - 1800)).drop("backoff_until")
    leases = q.where((F.col("physical_queue") == "refresh") & (F.col("next_fetch_at") <= now)).join(backing.select("host"), "host", "left_anti")
    leases = leases.select("url", "host", "physical_queue", F.md5("url").alias("lease_token"), (F.col("next_fetch_at") + 2592000).alias("lease_expires_at"))
    return Snapshot(ledger(table(spark, d, "url_ledger")), q, blocked, leases, states, table(spark, d, "host_ledger").withColumn("host", F.lower("host")), now)
