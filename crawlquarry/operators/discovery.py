"""Scoring and capped admission of the links of crawled pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlquarry.functions import content, policy, urls

# Base values, adjustments and penalties in hundredths.
SEED_VALUE, SAME_HOST_VALUE, SEED_HOST_VALUE, EXTERNAL_VALUE = 200, 125, 110, 80
ADJUSTMENT = {"generic_page": 0, "document_page": 15, "redirect_hub": -30, "registry_listing": -35}
LEAST_VALUE = 25
HOST_PENALTY = 35
PARENT_PENALTY = {"registry_listing": 20, "redirect_hub": 10}
NOFOLLOW_PENALTY, MOST_PARENT_PENALTY = 15, 35
# Fixed values: (mode, upper ratio of pending to target, least value, per page, per target host, new external hosts).
BANDS = (("expand", 0.6, 0.5, 200, 8, 8), ("balanced", 1.2, 0.8, 160, 6, 5), ("reduce", 1.8, 1.0, 80, 4, 2), ("drain", float("inf"), 1.15, 40, 2, 1))


@dataclass(frozen=True)
class Control:
    """Admission limits in force."""

    mode: str
    least_value: float
    per_page: int
    per_target_host: int
    new_external_hosts: int

    @property
    def active(self) -> bool:
        return self.mode in ("reduce", "drain")


def control(pending: int, target: int) -> Control:
    """The band that pending URLs fall in."""
    if target <= 0:
        raise ValueError("target must be positive")
    ratio = max(0, pending) / target
    mode, _, *limits = next(b for b in BANDS if ratio < b[1])
    return Control(mode, *limits)


def page_links(pages: DataFrame) -> DataFrame:
    """(page, parent_url, parent_host, parent_archetype, nofollow, url, host): one row a distinct normalised link of a page.

    Without a column ``meta_robots`` no page forbids following its links.
    """
    robots = F.lower(F.coalesce("meta_robots", F.lit(""))) if "meta_robots" in pages.columns else F.lit("")
    links = pages.where(F.col("outlinks").isNotNull()).select(
        F.col("url_hash").alias("page"), F.col("url").alias("parent_url"), urls.host_key("url").alias("parent_host"), parent_archetype().alias("parent_archetype"), robots.contains("nofollow").alias("nofollow"),
        F.explode(F.array_distinct(F.transform("outlinks", urls.normalize_url))).alias("url"),
    )
    return links.withColumn("host", urls.host_key("url"))


def parent_archetype() -> Column:
    """Archetype of a fetched page from its URL, title, size and type."""
    title = F.lower(F.coalesce("title", F.lit("")))
    kind = content.content_type("content_type")
    hints = title.rlike("index of|directory listing|" + "|".join(urls.LISTING_SEGMENTS))
    large = F.coalesce("content_length", F.lit(0)) >= 524288
    return F.when(urls.is_listing("url") | hints | large | ((kind != "") & ~kind.contains("html")), "registry_listing").otherwise(urls.archetype("url"))


def parent_context() -> Column:
    """Why a parent weakens its links: it says nofollow, it is a listing or redirect, or nothing."""
    return F.when(F.col("nofollow"), "nofollow").when(F.col("parent_archetype").isin("registry_listing", "redirect_hub"), "low_signal").otherwise("generic")


def scored_links(links: DataFrame, seed_hosts: DataFrame, host_context: DataFrame) -> DataFrame:
    """Links with archetype, value in hundredths before and after the host's penalty, and what is known of the host.

    ``seed_hosts`` (host); ``host_context`` (host, low_value).
    """
    j = links.join(seed_hosts.select("host", F.lit(True).alias("is_seed")), "host", "left").join(host_context.select("host", F.lit(True).alias("known"), "low_value"), "host", "left")
    j = j.withColumns({"is_seed": F.coalesce("is_seed", F.lit(False)), "known": F.coalesce("known", F.lit(False)), "low_value": F.coalesce("low_value", F.lit(False)), "archetype": urls.archetype("url")})
    base = F.when(F.col("host") == F.col("parent_host"), SAME_HOST_VALUE).when(F.col("is_seed"), SEED_HOST_VALUE).otherwise(EXTERNAL_VALUE)
    adjust = F.lit(0)
    for name, value in ADJUSTMENT.items():
        adjust = F.when(F.col("archetype") == name, value).otherwise(adjust)
    of_parent = F.lit(0)
    for name, value in PARENT_PENALTY.items():
        of_parent = F.when(F.col("parent_archetype") == name, value).otherwise(of_parent)
    penalty = F.least(F.lit(MOST_PARENT_PENALTY), of_parent + F.when(F.col("nofollow"), NOFOLLOW_PENALTY).otherwise(0))
    value = F.greatest(F.lit(LEAST_VALUE), base + adjust - penalty)
    j = j.withColumn("raw_value", value)
    return j.withColumn("value", F.when(F.col("low_value"), F.greatest(F.lit(LEAST_VALUE), F.col("raw_value") - HOST_PENALTY)).otherwise(F.col("raw_value")))


def in_scope(url, start_url) -> Column:
    """Whether a link stays on the host and port a crawl started at."""
    return urls.netloc(url) == urls.netloc(start_url)


def decided_links(scored: DataFrame, c: Control, same_host: bool = False) -> DataFrame:
    """Scored links with the first reason that applies, ``candidate`` for those that go on to the caps.

    With ``same_host`` links that leave their parent's host are out of scope before anything else is asked.
    """
    least = round(c.least_value * 100)
    start = F.when(~in_scope("url", "parent_url"), "scope_filtered") if same_host else F.when(F.lit(False), "scope_filtered")
    return scored.withColumn("parent_context", parent_context()).withColumn(
        "reason",
        start.when(urls.egress_reason("url") != "allowed", "egress_blocked")
        .when(F.col("parent_context") == "nofollow", "nofollow_parent")
        .when(F.col("archetype").isin("redirect_hub", "registry_listing"), "low_value_archetype")
        .when(F.col("low_value") & (F.col("value") < least), "host_policy_penalty")
        .when(F.col("value") < least, "score_below_threshold")
        .otherwise("candidate"),
    )


def ranked_candidates(decided: DataFrame) -> DataFrame:
    """Candidates with their place on their page, by value and URL."""
    return decided.where(F.col("reason") == "candidate").withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("value"), "url")))


def capped_links(decided: DataFrame, c: Control) -> DataFrame:
    """Candidates with the outcome of the greedy caps of their page, by windows.

    In order of value and URL a link is refused once its page is full, if it would open one
    new external host too many under pressure, or if its host is full on the page.
    """
    page = Window.partitionBy("page")
    rows = ranked_candidates(decided)
    new = (F.col("host") != F.col("parent_host")) & ~F.col("is_seed") & (F.col("host") != "") & ~F.col("known")
    rows = rows.withColumn("is_new", new).withColumn("first_r", F.min("r").over(Window.partitionBy("page", "host")))
    rows = rows.withColumn("nth_new", F.dense_rank().over(Window.partitionBy("page", "is_new").orderBy("first_r")))
    limited = F.col("is_new") & (F.col("nth_new") > c.new_external_hosts) if c.active and c.new_external_hosts > 0 else F.lit(False)
    rows = rows.withColumn("pressure", limited)
    rows = rows.withColumn("nth_of_host", F.row_number().over(Window.partitionBy("page", "host", "pressure").orderBy("r")))
    stays = ~F.col("pressure") & ((F.col("nth_of_host") <= c.per_target_host) if c.per_target_host > 0 else F.lit(True))
    rows = rows.withColumn("stays", stays)
    before = F.coalesce(F.sum(F.col("stays").cast("int")).over(page.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = (before >= c.per_page) if c.per_page > 0 else F.lit(False)
    outcome = F.when(full, "per_page_cap").when(F.col("pressure"), "new_host_pressure").when(~F.col("stays"), "per_target_host_cap").otherwise("admitted")
    return rows.withColumn("outcome", outcome).drop("is_new", "first_r", "nth_new", "nth_of_host", "stays", "pressure")


def admission_counts(decided: DataFrame, capped: DataFrame) -> DataFrame:
    """(reason, n) over all links; links admitted to generic pages of other hosts are also counted as ``external_generic``."""
    refused = decided.where(F.col("reason") != "candidate").groupBy("reason").agg(F.count("*").alias("n"))
    generic = (F.col("outcome") == "admitted") & (F.col("archetype") == "generic_page") & (F.col("host") != "") & (F.col("host") != F.col("parent_host")) & ~F.col("is_seed")
    outcomes = F.when(generic, F.array("outcome", F.lit("external_generic"))).otherwise(F.array("outcome"))
    return refused.unionByName(capped.select(F.explode(outcomes).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")))


def admission_summary(counts: DataFrame) -> DataFrame:
    """One row from (reason, n): links extracted, admitted and rejected, and the share admitted (null without links)."""
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    reason = F.col("reason")
    c = counts.agg(of(reason != "external_generic").alias("extracted"), of(reason == "admitted").alias("admitted"), of(~reason.isin("admitted", "external_generic")).alias("rejected"), of(reason == "external_generic").alias("external_generic"))
    return c.withColumn("ratio", F.when(F.col("extracted") > 0, F.round(F.col("admitted") / F.col("extracted"), 4)))


def host_contexts(host_ledger: DataFrame, host_state: DataFrame) -> DataFrame:
    """(host, low_value) of the hosts the ledger knows."""
    states = host_state.select(F.col("host_key").alias("host"), "consecutive_failures")
    return host_ledger.join(states, "host", "left").select("host", policy.low_value_host("consecutive_failures", "robots_status", "failure_count", "success_count").alias("low_value"))
