"""Read-only integrity checks of a frontier snapshot: each gives its violating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions import urls
from crawlquarry.operators.frontier import Snapshot


def memberships(s: Snapshot) -> DataFrame:
    """(url, place): every queue, quarantine and lease a URL is in."""
    return (
        s.pending.select("url", F.col("physical_queue").alias("place"))
        .unionByName(s.blocked.select("url", F.concat("physical_queue", F.lit(":blocked")).alias("place")))
        .unionByName(s.leases.select("url", F.concat("physical_queue", F.lit(":leased")).alias("place")))
    )


def duplicate_memberships(s: Snapshot) -> DataFrame:
    return memberships(s).groupBy("url").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("place")), ",").alias("places")).where("n > 1")


def terminal_memberships(s: Snapshot) -> DataFrame:
    return memberships(s).join(s.ledger.where(F.col("terminal_reason").isNotNull()).select("url", "terminal_reason"), "url")


def expired_leases(s: Snapshot) -> DataFrame:
    return s.leases.where(F.col("lease_expires_at") < s.now)


def orphan_heads(heads: DataFrame, s: Snapshot) -> DataFrame:
    return heads.join(s.queue.select(F.col("url").alias("head_url"), "physical_queue").distinct(), ["head_url", "physical_queue"], "left_anti")


def mismatched_heads(heads: DataFrame, s: Snapshot) -> DataFrame:
    q = s.queue.select(F.col("url").alias("head_url"), "physical_queue", F.col("host").alias("queue_host")).distinct()
    return heads.join(q, ["head_url", "physical_queue"]).where(F.col("host") != F.col("queue_host"))


def missing_identity(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("url_hash").isNull() | (F.col("url_hash") == "") | F.col("url_length").isNull() | (F.coalesce("url_identity_version", F.lit(0)) != urls.IDENTITY_VERSION))


def hash_mismatches(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("url_hash").isNotNull() & (F.col("url_hash") != "") & (F.col("url_hash") != urls.identity_hash("url")))


def duplicate_hashes(ledger: DataFrame, samples: int = 3) -> DataFrame:
    """Hashes of several URLs with some of them."""
    return ledger.where(F.col("url_hash").isNotNull() & (F.col("url_hash") != "")).groupBy("url_hash").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("url")), 1, samples).alias("urls")).where("n > 1")


def length_mismatches(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("url_length").isNotNull() & (F.col("url_length") != urls.identity_length("url")))


def too_long(s: Snapshot, most: int = urls.MAX_URL_BYTES) -> DataFrame:
    return memberships(s).where(urls.identity_length("url") > most)
